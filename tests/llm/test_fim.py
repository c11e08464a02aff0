import hashlib
import random
import re

import corpus
import pytest
from pyspark.sql import functions as F

from burrow.llm import fim, queries

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def brute(key, text, rate=100, spm=50):
    t = text or ""
    lines = LINES.findall(t)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    one, two = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = ("".join(lines[a:b]) for a, b in ((0, one), (one, two), (two, len(lines))))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (key, len(lines), "plain", None, None, t, t)
    if h[3] % 100 < spm:
        return (key, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t)
    return (key, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t)


def texts():
    rng = random.Random(31)
    out = [t for _, t, *_ in corpus.rows(n=20)]
    out += ["\n", "\n\n\n", "a\n", "\na", "a\r\nb\rc d\x0be\x85f\n", "x<P>y", "x\n<S>", "<M>", "<P", "P>\n<S\nM>", "<\n<P\n", "\U0001f600\n\U0001f601x", "$1\\n\\", "<|endoftext|>\n"]
    out += ["".join(rng.choice("ab<PSM>\n\r") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    out += ["line\n" * 50_000, "x" * 1_000_000, None]
    return out


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_equals_brute_force(spark, rate, spm):
    data = [(i, t, "en", "s") for i, t in enumerate(texts())] + [(None, "no id\nat all\n", "en", "s"), (3, "twice\n", "en", "s"), (3, "twice\n", "en", "s"), (-5, "a\nb\nc", "en", "s")]
    docs = corpus.frame(spark, data).withColumn("units", F.lit("clash")).withColumn("form", F.lit(1))
    got = fim.restored(fim.transform(docs, rate=rate, spm=spm))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(k, t, rate, spm) for k, t, *_ in data), key=repr)


@pytest.mark.parametrize("unit,pattern", [("lines", r"[^\n]*\n|[^\n]+"), ("words", r"\s*\S+(?:\s+\Z)?|\s+"), ("characters", r"[\s\S]")])
def test_units_are_those_of_the_grammar(spark, unit, pattern):
    strip = [t.encode("ascii", "ignore").decode() for t in texts() if t is not None and len(t) < 10_000]
    rows = spark.createDataFrame([(t,) for t in strip], "t string").select("t", fim.units(F.col("t"), unit).alias("u")).collect()
    for r in rows:
        assert "".join(r["u"]) == r["t"] and all(r["u"])
        if unit == "lines" or unit == "characters":
            assert r["u"] == re.findall(pattern, r["t"])
        else:
            assert len(r["u"]) <= max(1, len(r["t"].split()) + 1)


def test_sentences(spark):
    row = spark.createDataFrame([("One. Two?  Three",)], "t string").select(fim.units(F.col("t"), "sentences").alias("u")).first()
    assert row["u"] == ["One.", " Two?", "  Three"]


def test_empty_table_and_no_python(spark):
    assert fim.transform(corpus.nothing(spark)).isEmpty()
    plan = queries.op13_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
