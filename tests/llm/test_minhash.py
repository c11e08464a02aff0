import random
import re

import corpus
import numpy as np
import pytest
from test_jaccard import border_pair, border_texts, brute

from burrow.llm import jaccard, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of(data):
    out = []
    for key, t, *_ in data:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((key, frozenset(zip(w, w[1:])) if len(w) >= 2 else frozenset([tuple(w)] if w else [])))
    return out


def expected(data):
    return sorted(((*r, r[0] == r[2]) for r in brute(data, pairs_of)), key=repr)


@pytest.mark.parametrize("block,bits", [(400, 29), (3, 29), (400, 0)])
def test_equals_brute_force(spark, monkeypatch, block, bits):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST_FILTER_BITS", bits)
    monkeypatch.setattr(jaccard, "SLOT_KEYS", 2_000)
    data = corpus.rows(n=30)
    df = minhash.near_dedup(corpus.frame(spark, data))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected(data)


def test_a_large_group_of_near_copies_and_short_texts(spark):
    rng = random.Random(21)
    base = corpus.prose(rng, 300)
    data = [(i, corpus.edited(rng, base, 0.01), "en", "s") for i in range(900)]
    data += [(1000 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))), "en", "s") for i in range(600)]
    got = sorted(map(tuple, minhash.near_dedup(corpus.frame(spark, data)).collect()), key=repr)
    assert got == expected(data)


@pytest.mark.parametrize("words,more", [(5, 1), (21, 5), (101, 25), (401, 100)])
def test_no_border_pair_is_lost(spark, words, more):
    got = minhash.near_dedup(corpus.frame(spark, border_texts(1500, words, more))).collect()
    assert {r["n_shingles"] for r in got} == {words - 1, words - 1 + more}
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2] == []


def test_similar_sets_share_enough_runs():
    """All small sizes at the exact border, and some larger than a sketch."""
    rng = np.random.default_rng(22)
    for n in [*range(4, 131), 150, 400, 2000]:
        for _ in range(100):
            x, y = border_pair(rng, n)
            (p, needed_p), (q, needed_q) = minhash.tokens(x, 80), minhash.tokens(y, 80)
            if len(x) != len(y) or (x != y).any():
                assert len(np.intersect1d(p, q)) >= max(needed_p.min(), needed_q.min())


def test_least_shared_is_the_tail_of_a_binomial():
    from math import comb

    tail = lambda c: sum(comb(128, i) * 0.8**i * 0.2 ** (128 - i) for i in range(c))
    c = minhash.least_shared(1, 80)
    assert tail(c) <= minhash.RISK < tail(c + 1)
    rng = np.random.default_rng(23)
    draws = rng.random((20_000, 128)) < 0.8
    runs = (draws[:, 2:] & draws[:, 1:-1] & draws[:, :-2]).sum(1)
    assert runs.min() >= minhash.least_shared(3, 80) and np.mean(runs < 40) == pytest.approx(_share_below(40), abs=0.01)


def _share_below(c):
    lo = [r for r in np.logspace(-9, -0.01, 400) if minhash.least_shared(3, 80, minhash.KEPT, r) >= c]
    return lo[0]


@pytest.mark.parametrize("size", [60, 500])
def test_search_finds_exactly_the_similar(size):
    rng = np.random.default_rng(24)
    base = [np.unique(rng.integers(0, 1 << 63, size, np.uint64)) for _ in range(4)]
    sets = []
    for _ in range(120):
        b = base[rng.integers(4)]
        kept = b[rng.random(len(b)) > rng.choice([0.0, 0.05, 0.12, 0.3])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, size // 8), np.uint64)])))
    sets += [np.empty(0, np.uint64)]
    index = minhash.Sketches(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if len(q) and 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert sorted(index.search(q, 80)) == want
    assert minhash.Sketches([]).search(sets[0], 80) == []


def test_a_very_long_text(spark):
    rng = random.Random(25)
    w = [corpus.word(rng) + str(i) for i in range(120_000)]
    data = [(1, " ".join(w), "en", "s"), (2, " ".join(w[:118_000]), "en", "s"), (3, " ".join(w[:60_000]), "en", "s")]
    assert sorted(map(tuple, minhash.near_dedup(corpus.frame(spark, data)).collect())) == [(1, 119_999, 1, True), (2, 117_999, 1, False), (3, 59_999, 3, True)]


def test_empty_table(spark):
    assert minhash.near_dedup(corpus.nothing(spark)).count() == 0
