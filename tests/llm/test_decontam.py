import random
import re

import corpus
import pytest

from burrow.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    places = {}
    for item, text in items:
        if item is None:
            continue
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            places.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for key, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for p, its in places.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= its
        out.append((key, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    data = corpus.rows()
    long = [t for _, t, *_ in data if t and len(words(t)) > 40]
    items = [(i, " ".join(words(t)[5 : 5 + n])) for i, (t, n) in enumerate(zip(long, [10, 11, 25, 40, 7, 3, 1, 12]))]
    items += [(90, None), (91, "..."), (None, items[0][1]), (92, items[0][1]), (92, items[1][1]), (93, "never said anywhere by anyone in any of these texts at all")]
    data += [(1000 + i, f"Before, {items[i % 8][1].upper()}! after {corpus.word(rng)} {items[(i + 1) % 8][1]}", "en", "s1") for i in range(20)]
    return data, items


def test_equals_brute_force(spark, case):
    data, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.measure(corpus.frame(spark, data), bench).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data, items)


def test_removal_keeps_rows_and_columns(spark, case):
    data, items = case
    docs = corpus.frame(spark, data)
    kept = decontam.remove_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    want = sorted(repr(r[0]) for r in brute(data, items) if not r[4])
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == want


def test_empty_sides(spark, case):
    bench = spark.createDataFrame(case[1], "item_id long, text string")
    assert decontam.measure(corpus.nothing(spark), bench).count() == 0
    assert decontam.measure(corpus.frame(spark, case[0]), bench.limit(0)).where("contaminated").count() == 0
