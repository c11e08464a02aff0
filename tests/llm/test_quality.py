import re
from collections import Counter

import corpus

from burrow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def depleted(data, share, docs):
    lines, texts = {}, {}
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(" \t\n\x0b\x0c\r")).lower()
    for _, t, _, src in data:
        texts.setdefault(src, set()).add(t)
        for x in (t or "").split("\n"):
            if WORD.search(x):
                lines.setdefault((src, norm(x)), set()).add(t)
    common = {k for k, v in lines.items() if len(v) >= docs and len(v) > share * len(texts[k[0]])}
    out = set()
    for _, t, _, src in data:
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and (src, norm(x)) in common)
        n = len(WORD.findall(t or ""))
        if n - gone < 20 and 2 * gone >= n and gone:
            out.add((src, t))
    return out


def test_equals_brute_force(spark):
    data = corpus.rows()
    boiler = "a line of more than twenty words that every page of the host s9 carries at its foot so that pages with nothing else are empty"
    data += [(2000 + i, boiler + "\n" + corpus.prose(corpus.random.Random(i), 60 if i % 2 else 4), "en", "s9") for i in range(12)]
    bad = depleted(data, 0.1, 4)
    assert bad
    got = quality.judge(corpus.frame(spark, data), line_docs=4).collect()
    want = [(i, *base(t), not base(t)[5] and (src, t) not in bad) for i, t, _, src in data]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_rejection_hands_rows_on(spark):
    data = corpus.rows()
    docs = corpus.frame(spark, data)
    kept = quality.reject_low_quality(docs)
    assert kept.columns == docs.columns
    verdict = quality.judge(docs).where("kept")
    assert sorted(repr(r[0]) for r in kept.select("doc_id").collect()) == sorted(repr(r[0]) for r in verdict.select("doc_id").collect())


def test_empty_table(spark):
    assert quality.judge(corpus.nothing(spark)).count() == 0
    assert quality.reject_low_quality(corpus.nothing(spark)).count() == 0


def test_common_lines_are_taken_out(spark):
    boiler = "share this page with your friends"
    rng = corpus.random.Random(5)
    data = []
    for i in range(30):
        own = [corpus.prose(rng, 30).replace("\n", " "), "", corpus.prose(rng, 30).replace("\n", " ")]
        if i < 24:
            own.insert(i % 4, boiler if i % 2 else f"  {boiler.title()} \t")
        data.append((i, "\n".join(own), "en", "a"))
    data += [(100, data[0][1], "en", "a"), (101, f"{boiler}\n{corpus.prose(rng, 40)}", "en", "b"), (102, "\n" + corpus.prose(rng, 40) + "\n", "en", None)]
    want = {i: t if src != "a" else "\n".join(x for x in t.split("\n") if x.strip().lower() != boiler) for i, t, _, src in data}
    assert sum(want[i] != t for i, t, _, _ in data) == 25
    docs = corpus.frame(spark, data)
    kept = quality.reject_low_quality(docs)
    assert kept.schema.names == docs.schema.names and {r["doc_id"]: r["text"] for r in kept.collect()} == want
    judged = quality.judge(docs, with_text=True)
    assert {r["doc_id"]: r["clean_text"] for r in judged.collect()} == want
