"""Encoding, counting, packing and the token store against the libraries."""

import random
import zlib

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from burrow.llm import packing, token_store
from burrow.llm.encoding import WordEncoder
from burrow.llm.queries import PIECE_BPE, WORD_BPE, vocabulary
from burrow.llm.token_count import PieceCounts, count_tokens

ODD = [" ", "  ", "\n", "a", "The", "É", "é!!", "<|endoftext|>", "<|", "|>", "中", "\t", "'s", "don't", "I", "İ", "µ", "12", "ª", "\x00", "😀", "ß", "　", " ", "é", "...", "###", "\x1c", "\x85", "▁", "<s>", "<0x0A>"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(vocabulary(WORD_BPE))


def test_encoder_equals_the_library(encoder):
    for t in odd_texts(4000) + [t for _, t, *_ in corpus.rows() if t]:
        assert encoder.ids(t.encode()).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_with_a_full_memory(encoder):
    small = WordEncoder(vocabulary(WORD_BPE), most=4)
    for t in odd_texts(300, 2):
        assert small.ids(t.encode()).tolist() == encoder.ids(t.encode()).tolist()


def test_counts_equal_the_library():
    counts = PieceCounts(vocabulary(PIECE_BPE))
    assert counts.splits and "the" in counts.whole
    for t in odd_texts(4000, 3) + [t for _, t, *_ in corpus.rows() if t]:
        assert counts.count(t) == len(counts.library.encode(t))


def test_count_rows(spark):
    data = corpus.rows()
    got = count_tokens(corpus.frame(spark, data), vocabulary(PIECE_BPE), limit=100).collect()
    lib = PieceCounts(vocabulary(PIECE_BPE)).library
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 100) for i, t, *_ in data]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert count_tokens(corpus.nothing(spark), vocabulary(PIECE_BPE)).count() == 0


def test_packing(spark, encoder):
    data = corpus.rows()
    got = packing.pack(corpus.frame(spark, data), vocabulary(WORD_BPE), capacity=256, docs_per_task=40).collect()
    want = []
    for i, t, *_ in data:
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, a, len(p := ids[a : a + 256]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    assert len(places) <= 1.1 * sum(r["length"] for r in got) / 256 + 8
    assert packing.pack(corpus.nothing(spark), vocabulary(WORD_BPE)).count() == 0


def test_sum_of_squares_takes_the_best_place():
    rng = random.Random(6)
    bins = packing.SumOfSquares(20)
    for _ in range(500):
        n = rng.randint(1, 20)
        before = bins.counts.copy()

        def after(gap):
            c = before.copy()
            if gap < 20:
                c[gap] -= 1
            if gap - n:
                c[gap - n] += 1
            return int((c[1:20] ** 2).sum())

        choices = [g for g in range(n, 20) if before[g] > 0] + [20]
        best = min(after(g) for g in choices)
        bins.place(n)
        assert int((bins.counts[1:20] ** 2).sum()) == best


def test_store_round_trip(spark, tmp_path, encoder):
    data = corpus.rows()
    path = str(tmp_path / "store")
    manifest = token_store.write(corpus.frame(spark, data), path, vocabulary(WORD_BPE), end_id=2, shard_bytes=20_000)
    assert manifest.count() > 1
    found = token_store.fetch(corpus.frame(spark, data), path).unionByName(token_store.keyless(spark, path))
    got = found.orderBy("start").collect()
    ids = {}
    for i, t, *_ in data:
        ids.setdefault(i, []).append(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in data), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r["doc_id"]]}
    for key in {i for i, *_ in data if i is not None}:
        stored = token_store.lookup(manifest, path, key)
        assert sorted(x.tolist() for x in stored) == sorted(ids[key])
    assert token_store.lookup(manifest, path, 10**9) == []
    other = spark.createDataFrame([(3,), (10**9,), (None,), (7,)], "doc_id long")
    assert {r["doc_id"] for r in token_store.fetch(other, path).collect()} == {3, 7}


def test_a_broken_index_shows(spark, tmp_path):
    """Results come through the hash: with its fingerprints gone nothing is found."""
    path = tmp_path / "store"
    docs = corpus.frame(spark, corpus.rows(n=10))
    token_store.write(docs, str(path), vocabulary(WORD_BPE))
    for f in path.glob("*.idx"):
        shard, raw = token_store.Shard(str(f)[:-4]), bytearray(f.read_bytes())
        for i in range(shard.keys):
            raw[shard.at_slots + 16 * i] ^= 1
        f.write_bytes(raw)
    assert token_store.fetch(docs, str(path)).count() == 0


def test_equal_rows_are_parted(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    path = str(tmp_path / "store")
    manifest = token_store.write(docs, path, vocabulary(WORD_BPE), shard_bytes=40_000)
    assert manifest.where("documents > 2000").isEmpty()
    got = token_store.keyless(spark, path).orderBy("start").collect()
    assert len(got) == 4000 and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:1]) * i for i in range(4000)]
    packed = packing.pack(docs, vocabulary(WORD_BPE), capacity=16, docs_per_task=500).withColumn("task", F.shiftright("sequence_id", 40))
    assert packed.groupBy("task").count().where("count > 2000").isEmpty()


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    manifest = token_store.write(corpus.nothing(spark), path, vocabulary(WORD_BPE))
    assert manifest.count() == 0 and token_store.keyless(spark, path).count() == 0 and token_store.fetch(corpus.nothing(spark), path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64) - (1 << 39)
    index, slots = token_store.PerfectHash.of(keys.view(np.uint64))
    assert sorted(slots.tolist()) == list(range(n))
    assert (index.find(keys) == slots).all()
    others = np.setdiff1d(np.arange(2000), keys)
    assert (index.find(others) >= 0).sum() <= 1
