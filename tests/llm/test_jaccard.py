import random
import re
from collections import Counter

import corpus
import numpy as np
import pytest

from burrow.llm import jaccard
from burrow.llm.components import components
from burrow.llm.textual import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(data):
    out = []
    for key, t, *_ in data:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((key, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute(data, sets_of=sets_of):
    sets = sets_of(data)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, s) in enumerate(sets):
        if key is not None and s:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i)) if s else key) for i, (key, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("block,queries,bits", [(400, 1000, 29), (3, 2, 29), (400, 1000, 0)])
def test_equals_brute_force(spark, monkeypatch, block, queries, bits):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST_FILTER_BITS", bits)  # 0: nothing is filtered
    monkeypatch.setattr(jaccard, "SLOT_KEYS", 2_000)
    monkeypatch.setattr(jaccard, "QUERIES_PER_TASK", queries)
    data = corpus.rows(n=30)
    got = jaccard.join(corpus.frame(spark, data)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data)


def test_a_chain_of_near_copies(spark, monkeypatch):
    """Each text is near its neighbours only; the component must still be one."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(8)
    w = [corpus.word(rng) + str(i) for i in range(400)]
    data = [(i, " ".join(w[i * 8 : i * 8 + 160]), "en", "s") for i in range(30)]
    assert {r[2] for r in brute(data)} == {0}
    assert sorted(map(tuple, jaccard.join(corpus.frame(spark, data)).collect()), key=repr) == brute(data)


def test_a_long_chain_settles(spark):
    """500 texts that slide along a long one: similar to their neighbours only, and one component."""
    rng = random.Random(9)
    w = [corpus.word(rng) + str(i) for i in range(500 * 12 + 160)]
    data = [(i, " ".join(w[i * 12 : i * 12 + 160]), "en", "s") for i in range(500)]
    rng.shuffle(data)
    assert {r["component_id"] for r in jaccard.join(corpus.frame(spark, data)).collect()} == {0}


@pytest.mark.parametrize("ordered", [True, False])
def test_components_of_long_paths(spark, ordered):
    rng = random.Random(10)
    ids = list(range(-2500, 2500)) if ordered else [rng.randrange(-(1 << 62), 1 << 62) for _ in range(5000)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(ids, ids[1:])] + [(ids[0], ids[0]), (1 << 62, (1 << 62) + 1)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == 5002
    assert {r["label"] for r in got if r["node"] < 1 << 62} == {min(ids)}
    assert {r["label"] for r in got if r["node"] >= 1 << 62} == {1 << 62}


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)]
    root = list(range(1200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {i: find(i) for link in links for i in link if link[0] != link[1]}
    assert {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_similar_sets_share_enough_signatures():
    """For random pairs at and around the least similarity, of all small sizes and some large ones."""
    rng = np.random.default_rng(12)
    for n in [*range(1, 70), 100, 127, 128, 200, 255, 256, 1000] * 6:
        a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        for _ in range(20):
            gone, new = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
            b = np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, np.uint64)])
            x, y = np.unique(a), np.unique(b)
            if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
                (p, needed_p), (q, needed_q) = jaccard.signatures(x, 80), jaccard.signatures(y, 80)
                assert len(np.intersect1d(p, q)) >= max(needed_p.min(), needed_q.min())


def border_pair(rng, n):
    """Sorted hash sets, the first of n hashes, that couldn't differ in one more and be similar enough."""
    own = int(rng.integers(0, n // 5 + 1))
    apart = (n - own) // 4
    own = min(own, apart)
    apart = (n - own) // 4
    a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
    b = np.concatenate([a[own:], rng.integers(0, 1 << 63, apart - own, np.uint64)])
    return np.sort(a), np.sort(b)


def test_border_pairs_share_what_either_needs():
    """Every size from 5 to 130, at the exact border, where sizes straddle steps of the needs, too."""
    rng = np.random.default_rng(15)
    for n in range(5, 131):
        for _ in range(150):
            x, y = border_pair(rng, n)
            assert 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
            (p, needed_p), (q, needed_q) = jaccard.signatures(x, 80), jaccard.signatures(y, 80)
            assert len(np.intersect1d(p, q)) >= max(needed_p.min(), needed_q.min())


def border_texts(pairs, words, more):
    """Pairs of a text and the same text with words of its own behind; ids 2 i and 2 i + 1."""
    rng = random.Random(16)
    out = []
    for i in range(pairs):
        w = [f"{corpus.word(rng)}{rng.randrange(1 << 40)}" for _ in range(words + more)]
        out += [(2 * i, " ".join(w[:words]), "en", "s"), (2 * i + 1, " ".join(w), "en", "s")]
    return out


def test_no_border_pair_is_lost(spark):
    """20 and 25 shingles, 20 of them shared: all of 4,000 pairs link."""
    got = jaccard.join(corpus.frame(spark, border_texts(4000, 24, 5))).collect()
    assert {r["n_shingles"] for r in got} == {20, 25}
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2] == []


def test_sets_with_many_empty_parts_meet():
    """Shingles that all fall into one part, so that hardly any part is held."""
    rng = np.random.default_rng(13)
    for n in [4, 7, 20, 40, 100]:
        a = np.unique(rng.integers(0, 1 << 40, n, np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 40, n // 10, np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            (p, needed_p), (q, needed_q) = jaccard.signatures(a, 80), jaccard.signatures(b, 80)
            assert len(np.intersect1d(p, q)) >= max(needed_p.min(), needed_q.min())


@pytest.mark.parametrize("bits", [0, 1, 6, 31])
def test_packed_keys(bits):
    rng = np.random.default_rng(14)
    keys = np.concatenate([rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2) + np.uint64(1), np.full(5, 1 << 63, np.uint64), np.array([0, 0, (1 << 64) - 1], np.uint64)])
    got = [(slot << 32) | int(low) for slot, p in jaccard.pack(keys, bits) for low in jaccard.unpacked([p])]
    kept, counts = np.unique(keys >> np.uint64(32 - bits), return_counts=True)
    assert sorted(got) == np.repeat(kept, np.minimum(counts, 2)).tolist()


def test_long_words_made_to_collide_differ():
    """Sums of powers modulo 2^64 meet for these two words of 2,048 letters, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048)).encode()
    two = bytes({97: 98, 98: 97}[c] for c in one)
    for kind in ("run", "alnum"):
        hashes = WordHashes(kind)
        assert hashes.of(one)[0] != hashes.of(two)[0]
        assert hashes.of(one.upper())[0] == hashes.of(one)[0] == hashes.of(b"x " + one + b" y")[1]


def test_search_finds_all_members_with_enough_overlap():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 300, np.uint64)
    sets = [np.unique(rng.choice(pool[:60], rng.integers(5, 50))) for _ in range(80)]
    index = jaccard.Index(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert sorted(index.search(q, 80)) == want


def test_block_links_connect_components():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 300, np.uint64)
    for _ in range(30):
        base = [rng.choice(pool, 40, replace=False) for _ in range(3)]
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.08]), rng.integers(0, 1 << 62, 40, np.uint64), base[rng.integers(3)])) for _ in range(25)]

        def parts(links):
            root = list(range(len(sets)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                root[max(find(a), find(b))] = min(find(a), find(b))
            return [find(i) for i in range(len(sets))]

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert parts(jaccard.block_links(sets, 80)) == parts(every)


def test_one_of_each_group_stays(spark):
    data = corpus.rows(n=30)
    docs = corpus.frame(spark, data)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    wanted = {c for _, n, c in brute(data) if n} | {k for k, n, _ in brute(data) if not n}
    assert set(ids) == wanted and all(v == 1 for k, v in ids.items() if k is not None)


def test_empty_table(spark):
    assert jaccard.join(corpus.nothing(spark)).count() == 0
