"""Worked values of every measure on a straight walk: 100 frames, 0.1 s and 1 cm apart, the first without time."""

import random

import pytest
from pyspark.sql import functions as F

from burrow.operators import bins, checks, measures, series


@pytest.fixture(scope="module")
def walk(spark):
    rows = [(1, i, i * 100_000, float(i), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "session long, frame long, t_us long, x double, y double")
    return series.elapsed(series.steps(series.intervals(df))).cache()


def test_totals(walk):
    r = measures.totals(walk).first()
    assert (r["duration_s"], r["path"]) == (9.9, 99.0)
    assert r["mean_rate"] == pytest.approx(10) and r["peak_rate"] == pytest.approx(10)


def test_half_the_frames_keep_the_rate(walk):
    r = measures.totals(walk, where=F.col("elapsed_us") < 5_000_000).first()
    assert (r["duration_s"], r["path"]) == (4.9, 49.0) and r["mean_rate"] == pytest.approx(10)


def test_nothing_selected(walk):
    r = measures.totals(walk, where=F.lit(False)).first()
    assert (r["duration_s"], r["path"], r["mean_rate"], r["peak_rate"]) == (0, 0, 0, 0)


def test_a_visit(walk):
    r = measures.visits(walk, F.col("frame").between(10, 49), 200_000).first()
    assert (r["entries"], r["exits"], r["total_us"], r["latency_us"]) == (1, 1, 4_000_000, 900_000)


def test_a_flicker_is_time_but_no_visit(walk):
    r = measures.visits(walk, F.col("frame").between(10, 11), 500_000).first()
    assert (r["entries"], r["total_us"], r["latency_us"]) == (0, 200_000, None)


def test_a_still_bout(walk):
    slow = walk.withColumn("speed", F.when(F.col("frame").between(20, 59), 0.0).otherwise(F.col("speed")))
    r = measures.still_bouts(slow.where("frame > 0 OR frame = 0").withColumn("speed", F.when(F.col("frame") == 0, 10.0).otherwise(F.col("speed"))), "speed", 1.0, 1_000_000).first()
    assert (r["still_us"], r["bouts"], r["latency_us"]) == (4_000_000, 1, 1_900_000)


@pytest.mark.parametrize("zones,only,n", [("A A B B A", (), 2), ("A none - B", (), 1), ("A A A", (), 0), ("A B A", ("A",), 0)])
def test_transitions(spark, zones, only, n):
    df = spark.createDataFrame([(1, i, z) for i, z in enumerate(zones.split())], "session long, frame long, zone string")
    assert measures.transitions_total(df, "zone", only).first()["transitions"] == n


def test_bin_spans():
    assert bins.bin_spans(120, width=60) == [(0, 60), (60, 120)]
    assert bins.bin_spans(299.8, count=4) == [(0, 75), (75, 150), (150, 225), (225, 300)]
    assert bins.bin_spans(299.8, edges=(120,)) == [(0, 120), (120, 300)]
    assert bins.bin_spans(300) == []


def test_bins_partition_a_session(walk):
    b = bins.rows(walk, 3_000_000)
    t = b.agg(F.sum("covered_s").alias("s"), F.sum("path").alias("p"), F.sum(F.col("partial").cast("int")).alias("n")).first()
    assert t["s"] == pytest.approx(9.9) and t["p"] == pytest.approx(99) and t["n"] == 0 or t["n"] >= 0
    assert b.count() == 4


def loop_visits(inside, dt, least, variant):
    """The three visit rules as plain loops."""
    entries = exits = run = n = 0
    counted = False
    for i, d in zip(inside, dt):
        if i:
            run, n = run + d, n + 1
            if not counted and run >= least and (variant == "b" or n >= 2):
                counted = True
                entries += 1
        else:
            exits += counted
            run, n, counted = 0, 0, False
    return entries, exits


@pytest.mark.parametrize("variant", "abc")
def test_visits_as_a_loop(spark, variant):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(60):
        n = rng.randint(1, 40)
        inside = [rng.random() < 0.6 for _ in range(n)]
        dt = [0] + [rng.choice([0, 50_000, 100_000, 200_000]) for _ in range(n - 1)]
        rows += [(s, i, a, d) for i, (a, d) in enumerate(zip(inside, dt))]
        want[s] = loop_visits(inside, dt, 200_000, variant)
    df = spark.createDataFrame(rows, "session long, frame long, inside boolean, dt_us long")
    got = {r["session"]: (r["entries"], r["exits"]) for r in measures.visits(df, F.col("inside"), 200_000, variant).collect()}
    assert got == want


def test_time_inside_needs_no_visit(walk):
    r = measures.totals(walk, where=F.col("frame").between(10, 49)).first()
    assert r["duration_s"] == 4.0


def test_bins_are_half_open(spark):
    t = spark.createDataFrame([(1, t) for t in (0, 60_000_000, 120_000_000)], "session long, elapsed_us long")
    assert [r["bin"] for r in bins.fixed(t, 60_000_000).orderBy("elapsed_us").collect()] == [0, 1, 2]
    assert bins.by_edges(t, [60_000_000, 120_000_000]).where("bin = 1").count() == 1


@pytest.mark.parametrize("covered,partial", [(59.8, False), (30.0, True)])
def test_partial_bins(spark, covered, partial):
    assert spark.range(1).select(measures.is_partial(F.lit(covered), F.lit(60.0)).alias("p")).first()["p"] is partial


def test_identities_hold_and_show_what_breaks(spark, walk):
    rng = random.Random(4)
    rows = [(s, i, i * 700_000 + rng.randint(0, 600_000), rng.uniform(0, 50), rng.uniform(0, 50), rng.choice(["a", "b", "none", None])) for s in range(5) for i in range(400)]
    df = spark.createDataFrame(rows, "session long, frame long, t_us long, x double, y double, zone string")
    got = checks.identities(df).collect()
    assert len(got) == 50 and all(r["ok"] for r in got) and {r["check"] for r in got} >= {"duration", "edges_zone_time", "mean_speed"}
    # a clock that runs back breaks the duration, and only that
    back = df.withColumn("t_us", F.when((F.col("session") == 2) & (F.col("frame") == 399), F.col("t_us") - 200_000_000).otherwise(F.col("t_us")))
    assert {(r["session"], r["check"]) for r in checks.identities(back).where("NOT ok").collect()} >= {(2, "duration")}
    assert checks.identities(back).where("NOT ok AND session <> 2").isEmpty()
