import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from burrow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, leaves long"


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 7) for r in data], SCHEMA)


def sequences(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r[2], r[4]) for r in sorted(rows)] for c, rows in own.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c - c % 100 if c >= 0 else c + (-c) % 100
        out[c] = seqs.get(rest, [])[:h] + own[h:]
    return out


def brute(seqs):
    """By plain recursion over sets of members."""
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in children[k]) if children[k] else 1
        saved[k] = sum(saved[c] for c in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed):
    """Shared starts, absent starts, negative ids, copies, nulls, ties, repeated rows and texts beyond the basic plane."""
    rng = random.Random(seed)
    texts = ["", "a", "ab", "\U0001f600x", "é", "the same", None]
    out = []
    for c in [*range(-120, -80), *range(0, 60), *range(195, 230), 5_000_001, -(10**12)]:
        turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.randint(1, 9))]
        out += turns
    out += [(c, t, "user", "copy") for c in range(300, 330) for t in range(7)]
    out += [(400, None, "system", "first"), (400, 1, "b", "tie"), (400, 1, "a", "tie"), (400, 1, "a", "other"), (400, 1, "a", "tie"), (None, 0, "user", "nobody")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    data = conversations(seed)
    seqs = sequences(data)
    assert rows_of(prefix_trie.trie(frame(spark, data), block=100)) == brute(rebuilt(seqs))
    assert rows_of(prefix_trie.trie(frame(spark, data))) == brute(seqs)


def test_snapshots_of_a_growing_conversation(spark):
    """Each conversation is the next one's start: the trie is as deep as there are conversations, the rounds are few."""
    data = [(c, t, "user", f"turn {t}") for c in range(1, 71) for t in range(c)]
    data += [(1000 + c, t, "user", f"turn {t}" if t < c else "fork") for c in range(0, 60, 7) for t in range(c + 2)]
    rounds = []
    real = prefix_trie.written
    try:
        prefix_trie.written = lambda df, name, keep=False: rounds.append(name) or real(df, name, keep)
        got = rows_of(prefix_trie.trie(frame(spark, data)))
    finally:
        prefix_trie.written = real
    assert got == brute(sequences(data))
    assert rounds.count("trie-round") <= 14


def test_one_conversation_with_most_of_the_rows(spark):
    """Its turns lie in several ranges, some of them alike in everything."""
    rng = random.Random(3)
    data = [(7, rng.choice([None, 3, *range(20, 1500)]), "user", rng.choice("abc")) for _ in range(3000)] + [(7, 3, "user", "same")] * 500
    data += [(c, t, "user", rng.choice("abc")) for c in range(8, 30) for t in range(20)]
    dealt = prefix_trie.numbered(frame(spark, data)).where("conv_id = 7")
    assert dealt.select("range").distinct().count() > 1
    assert [r["pos"] for r in dealt.orderBy("pos").select("pos").collect()] == list(range(1, 3501))
    assert rows_of(prefix_trie.trie(frame(spark, data))) == brute(sequences(data))


def test_ids_of_one_node_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    data = [(c, 0, "user", "hello") for c in [*range(-20, 20), 10**15, -(10**15)]]
    assert rows_of(prefix_trie.trie(frame(spark, data))) == brute(sequences(data))


def test_no_conversations(spark):
    assert prefix_trie.trie(frame(spark, []), block=100).isEmpty()
    assert prefix_trie.trie(frame(spark, [(None, 0, "user", "x")])).isEmpty()


def test_totals_don_t_depend_on_partitions(spark):
    data = conversations(4)
    once = rows_of(prefix_trie.trie(frame(spark, data).repartition(7, F.rand(1)), block=100))
    assert once == brute(rebuilt(sequences(data)))
