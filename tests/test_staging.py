"""Templates against Python's own evaluation, and stages that run again exactly where something changed."""

import json
import math

import pytest
from pyspark.sql import functions as F

from burrow.operators import templates
from burrow.plans import staging
from burrow.sources import stages

EXPRESSIONS = ["a / b", "a // 4", "-a // 4", "a % b", "-a % 3", "a ** 2 - b", "round(a / 8, 2)", "round(2.5)", "int(-a / 3)", "min(a, b, 3)", "max(a, b)", "abs(b - a)", "sqrt(a - b)", "log(b)", "exp(1)", "a if a > b else b", "1 < a <= 7", "a > 1 and b > 1", "not b", "nobody + 1", "len(word)", "float(word)", "a / (b - b)", "1 if b else a / 0", "(a / b) * (b - 2)", "int('7') + a"]


def python(text, env):
    safe = {"abs": abs, "max": max, "min": min, "len": len, "round": round, "int": int, "float": float, "sqrt": math.sqrt, "log": math.log, "exp": math.exp}
    try:
        return float(eval(text, {"__builtins__": {}}, {**safe, **env}))  # noqa: S307
    except ZeroDivisionError:
        return 0.0
    except Exception:
        return None


@pytest.mark.parametrize("a,b", [(7, 2), (5, 0), (1, 9), (0, 0)])
def test_calculations_are_those_of_python(spark, a, b):
    known = {"a": F.lit(a), "b": F.lit(b), "word": F.lit("word")}
    row = spark.range(1).select(*(templates.calculation(t, known).alias(f"e{i}") for i, t in enumerate(EXPRESSIONS))).first()
    for got, text in zip(row, EXPRESSIONS):
        want = python(text, {"a": a, "b": b, "word": "word"})
        assert got == (None if want is None else pytest.approx(want)), text


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "[1, 2]", "open('x')", "lambda: 1", "a[0]", "1 in a", "f'{a}'", "max(a, key=b)"])
def test_nothing_else_is_allowed(spark, text):
    with pytest.raises(ValueError):
        templates.calculation(text, {"a": F.lit(1)})


def test_formats(spark):
    cases = [("{:.2f}", 1.005, "1.00"), ("{:.1%}", 0.256, "25.6%"), ("{:d} of 9", 4.0, "4 of 9"), ("{}", "x", "x"), ("{:,.1f}", 12345.67, "12,345.7"), ("{:.3f}", None, "")]
    row = spark.range(1).select(*(templates.formatted(F.lit(v), p) for p, v, _ in cases)).first()
    assert list(row) == [w for _, _, w in cases]
    with pytest.raises(ValueError):
        templates.formatted(F.lit(1), "{:>10}")


def test_arguments():
    t = templates.Template.of({"id": "t", "name": "T", "parameters": [{"name": "n", "type": "INT", "default": "4", "min": 1, "max": 9}, {"name": "on", "type": "BOOL", "default": "yes"}, {"name": "c", "type": "CHOICE", "default": "a", "choices": ["a", "b"]}, {"name": "free", "type": "FLOAT"}]})
    assert t.arguments() == {"n": 4, "on": True, "c": "a", "free": None} and t.arguments({"n": "9", "free": "1.5"})["free"] == 1.5
    for bad in ({"n": 10}, {"n": 0}, {"c": "z"}, {"n": "x"}):
        with pytest.raises(ValueError):
            t.arguments(bad)
    with pytest.raises(ValueError):
        templates.Template.of({"name": "no id"})


def test_tables_and_hooks_over_one_aggregation(spark, tmp_path):
    lines = spark.createDataFrame([("a/m1-Box3-2024-01-02-120000.tsv", t) for t in ("poke left", "poke right", "reward", None)] + [("b/other.tsv", "poke")], "file string, line string")
    one = {"id": "one", "name": "One", "counters": {"p": {"match": "poke"}, "r": {"match": "reward"}}, "calculations": {"x": "r / p"}, "columns": [{"key": "session"}, {"key": "p", "label": "Pokes"}, {"key": "x"}]}
    two = {"id": "two", "name": "Two", "counters": {"q": {"match": "poke"}}, "columns": [{"key": "q"}], "hook_class": "Twice", "parameters": [{"name": "k", "type": "INT", "default": 2}]}
    for t in (one, two):
        (tmp_path / t["id"]).mkdir()
        (tmp_path / t["id"] / "template.json").write_text(json.dumps(t))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "template.json").write_text("{")
    good, bad = templates.load_templates(spark, str(tmp_path))
    assert list(good) == ["one", "two"] and len(bad) == 1
    assert templates.needles(list(good.values())) == ["poke", "reward"]
    out = templates.tables(lines, list(good.values()), {"two": {"k": 5}}, {"Twice": lambda d, p: d.withColumn("q", F.col("q") * p["k"])})
    assert sorted(map(tuple, out["one"].collect())) == [("m1-2024-01-02", 2, 0.5), ("other.tsv", 1, 0.0)]
    assert sorted(r["q"] for r in out["two"].collect()) == [5, 10]


def table(spark, **changed):
    base = {"digest": "d", "model": "m", "gate": "g", "zones": "z", "unit": "u"}
    rows = [(s, *({**base, **changed} if s == 2 else base).values()) for s in range(4)]
    return spark.createDataFrame(rows, "session long, digest string, model string, gate string, zones string, unit string")


@pytest.mark.parametrize("changed,reached", [({"digest": "e"}, {"ingest", "track", "correct", "measure"}), ({"model": "n"}, {"track", "correct", "measure"}), ({"zones": "y"}, {"space", "measure"}), ({"unit": None}, {"measure"}), ({}, set())])
def test_a_change_reaches_exactly_its_descendants(spark, changed, reached):
    done = stages.keys(table(spark), staging.STAGES)
    got = stages.stale(stages.keys(table(spark, **changed), staging.STAGES), done).select("session", "stage").collect()
    assert {tuple(r) for r in got} == {(2, s) for s in reached}


def test_values_can_t_be_taken_for_their_neighbours(spark):
    two = [stages.Stage("s", parameters=("model", "gate"))]
    a, b = (stages.keys(table(spark, model=m, gate=g), two).where("session = 2").first()["key"] for m, g in (("x|=1:y", "z"), ("x", "y|=1:z")))
    assert a != b
    assert stages.keys(table(spark, unit=None), [stages.Stage("s", parameters=("unit",))]).where("session = 2").first()["key"] != stages.keys(table(spark, unit="-"), [stages.Stage("s", parameters=("unit",))]).where("session = 2").first()["key"]


def test_only_what_is_stale_runs(spark):
    seen = []

    def step(name):
        def run(s, before):
            seen.append((name, sorted(r["session"] for r in s.collect()), sorted(before)))
            return s.select("session", F.lit(name).alias("made"), F.col("unit"))

        return run

    steps = {s.name: step(s.name) for s in staging.STAGES}
    stamps, ran = stages.run_stale(spark, table(spark), staging.STAGES, steps)
    assert [n for n, _, _ in seen][-1] == "measure" and all(x == [0, 1, 2, 3] for _, x, _ in seen) and ran.count() == 20
    seen.clear()
    stamps, ran = stages.run_stale(spark, table(spark, gate="h"), staging.STAGES, steps, stamps)
    assert seen == [("correct", [2], ["track"]), ("measure", [2], ["correct", "space"])] and ran.count() == 2
    seen.clear()
    stamps, ran = stages.run_stale(spark, table(spark, gate="h"), staging.STAGES, steps, stamps)
    assert seen == [] and ran.isEmpty()
    assert stages.results(spark, stamps, "measure").count() == 4
    assert {r["session"]: r["run"] for r in stages.latest(stamps.where("stage = 'measure'")).collect()} == {0: 1, 1: 1, 2: 2, 3: 1}


def test_circles_are_errors():
    with pytest.raises(ValueError):
        stages.ordered([stages.Stage("a", after=("b",)), stages.Stage("b", after=("a",))])
    with pytest.raises(ValueError):
        stages.ordered([stages.Stage("a", after=("nobody",))])
