import random
import re
import zlib

import corpus
import numpy as np
import public_tokenizers
import pytest
import test_decontam
import test_jaccard
import test_quality

import corpus_pipeline
from burrow.llm import toxicity


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(21)
    clean = [(i, corpus.prose(rng, 80), "en", f"s{i % 3}") for i in range(60)]
    near = [(100 + i, corpus.edited(rng, clean[0][1], 0.01) if i else clean[0][1], "en", "s0") for i in range(6)]
    toxic = [(200 + i, f"{corpus.prose(rng, 15)} {rng.choice(['grubnik', 'plumfex'])} {corpus.prose(rng, 20)}", "en", "s1") for i in range(30)]
    passage = " ".join(clean[5][1].split()[10:30])
    leaked = [(300 + i, f"{corpus.prose(rng, 30)} {passage} {corpus.prose(rng, 30)}", "en", "s2") for i in range(4)]
    short = [(400, "too short", "en", "s0"), (401, None, "en", "s0"), (402, "one two three four five six seven eight " * 9, "en", "s0")]
    docs = corpus.frame(spark, clean + near + toxic + leaked + short)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, int(i >= 200)) for i, *_ in clean + toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    group = {0, *range(100, 106)}
    assert ids - group == {i for i, *_ in clean if i not in (0, 5)} and len(ids & group) >= 1
    assert not ids & set(range(200, 500))


def planted(spark, where):
    """Documents of all kinds that stages drop or change, written with benchmark and labels."""
    rng = random.Random(33)
    boiler = "share this page with your friends and subscribe to our letter"
    clean = [(i, corpus.prose(rng, 90).replace("\n", " ") + (f"\n{boiler}" if i % 2 else ""), "en", "s0") for i in range(60)]
    near = [(100 + i, corpus.edited(rng, clean[0][1], 0.01), "en", "s1") for i in range(8)] + [(120 + i, clean[4][1], "en", "s1") for i in range(3)]
    toxic = [(200 + i, f"{corpus.prose(rng, 15)} {rng.choice(['grubnik', 'plumfex'])} {corpus.prose(rng, 20)}", "en", "s1") for i in range(30)]
    items = [(k, " ".join(corpus.word(rng) + str(k) for _ in range(n))) for k, n in ((1, 14), (2, 30), (3, 4))] + [(4, None)]
    leaked = [(300 + i, f"{corpus.prose(rng, 30)} {' '.join(items[i % 3][1].split()[: 12])} {corpus.prose(rng, 30)}", "en", "s2") for i in range(6)]
    low = [(400, "too short", "en", "s0"), (401, None, "en", "s0"), (402, "one two three four five six seven eight " * 9, "en", "s0"), (403, f"{boiler}\n{boiler}\n{boiler}", "en", "s0")]
    long = [(500, " ".join(corpus.word(rng) for _ in range(9000)), "en", "s2")]
    docs = corpus.frame(spark, clean + near + toxic + leaked + low + long)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return docs, items


def data_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def through(spark, tmp_path_factory):
    """Each stage's input and output, written and read as the pipeline does."""
    where = str(tmp_path_factory.mktemp("stages"))
    docs, items = planted(spark, where)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{where}/{name}"
        stage(spark, docs, where).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return where, items, out


def test_quality_rules_equal_brute_force_on_their_input(through):
    before, after = (data_of(d) for d in through[2]["quality rules"])
    lines, texts = {}, {}
    for _, t, _, src in before:
        texts.setdefault(src, set()).add(t)
        for x in (t or "").split("\n"):
            lines.setdefault((src, x.strip().lower()), set()).add(t)
    common = {k for k, v in lines.items() if k[1] and len(v) >= 20 and len(v) > 0.1 * len(texts[k[0]])}
    gone = test_quality.depleted(before, 0.1, 20)
    want = []
    for i, t, lang, src in before:
        if not test_quality.base(t)[5] and (src, t) not in gone:
            want.append((i, "\n".join(x for x in t.split("\n") if (src, x.strip().lower()) not in common), lang, src))
    assert common and after == sorted(want, key=repr) and any(t != dict((r[0], r[1]) for r in before)[i] for i, t, *_ in after)


def test_toxicity_drops_what_its_model_predicts(spark, through):
    where, _, out = through
    before, after = out["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{where}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(before, model).where("predicted = 1").collect()}
    assert data_of(after) == [r for r in data_of(before) if r[0] not in bad]
    assert bad == {i for i, t, *_ in data_of(before) if re.search("grubnik|plumfex", t)}


def test_jaccard_join_equals_brute_force_on_its_input(through):
    before, after = (data_of(d) for d in through[2]["n-gram Jaccard join"])
    keep = {c for _, _, c in test_jaccard.brute(before)}
    assert after == [r for r in before if r[0] in keep] and len(after) < len(before)


def test_decontamination_equals_brute_force_on_its_input(through):
    before, after = (data_of(d) for d in through[2]["benchmark decontamination"])
    hit = {r[0] for r in test_decontam.brute(before, through[1]) if r[2]}
    assert after == [r for r in before if r[0] not in hit] and len(hit) >= 4


def test_packing_holds_every_piece_of_its_input(through):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = through[2]["best-fit packing"]
    want = []
    for i, text, *_ in data_of(before):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(p := ids[s : s + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    rows = after.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want) and max(r["piece"] for r in rows) > 3
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def _tables(spark, where):
    spark.createDataFrame([(1, "ten words of a benchmark item that no text here has"), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    """Nulls, empties, repeated rows and columns that clash with the operators' own."""
    _tables(spark, str(tmp_path))
    docs = corpus.frame(spark, corpus.rows(n=25))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        docs = kept
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() > 0


def test_empty_tables(spark, tmp_path):
    _tables(spark, str(tmp_path))
    corpus.nothing(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
