"""Track measures, zone renaming, sinks and presets against small worked cases."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from burrow.operators import tracks
from burrow.sources import reports

BOX = [(0.2, 0.2), (0.6, 0.2), (0.6, 0.8), (0.2, 0.8)]


def test_frame_scale_is_found(spark):
    true = 1.5
    rows = []
    for i in range(400):
        x, y = (i % 20) * 7.5, (i // 20) * 7.5  # up to 142.5, beyond the declared 100
        u, v = x / (100 * true), y / (100 * true)
        rows.append((1, i, x, y, "box" if 0.2 < u < 0.6 and 0.2 < v < 0.8 else None))
    rows += [(2, i, float(i), float(i), "box") for i in range(50)]  # inside the frame
    rows += [(3, i, 500.0, 500.0, "box") for i in range(5)]  # too few
    points = spark.createDataFrame(rows, "session long, frame long, x double, y double, zone string")
    zones = spark.createDataFrame([("box", BOX)], "name string, points array<struct<x:double,y:double>>")
    got = {r["session"]: r["scale"] for r in tracks.frame_scale(points, zones, 100.0, 100.0).collect()}
    assert got[2] == 1.0 and got[3] is None
    assert abs(got[1] - true) <= 0.1


def test_evenly_spaced_keeps_both_ends(spark):
    rows = [(s, i) for s, n in ((1, 997), (2, 10), (3, 21)) for i in range(n)]
    got = tracks.evenly_spaced(spark.createDataFrame(rows, "session long, frame long"), 20).groupBy("session").agg(F.count("*").alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi")).collect()
    for r in got:
        size = {1: 997, 2: 10, 3: 21}[r["session"]]
        assert r["lo"] == 0 and r["hi"] == size - 1 and r["n"] <= max(20, min(size, 20))


def test_active_span_reaches_the_next_sample(spark):
    df = spark.createDataFrame([(1, i, i * 10, i in (1, 2, 5)) for i in range(6)], "session long, frame long, t_us long, a boolean")
    got = sorted((r["start"], r["end"]) for r in tracks.active_spans(df, F.col("a")).collect())
    assert got == [(10, 30), (50, 50)]


def test_clock_is_one_column_a_session(spark):
    rows = [(1, 0, None, 5.0), (1, 1, 7.0, 6.0), (1, 2, None, 7.0), (2, 0, None, 4.0), (3, 3, None, None)]
    df = spark.createDataFrame(rows, "session long, frame long, mcu double, cam double")
    got = {(r["session"], r["frame"]): (r["clock_source"], r["clock_ms"]) for r in tracks.session_clock(df, ["mcu", "cam"], 30.0).collect()}
    assert got == {(1, 0): ("mcu", 0.0), (1, 1): ("mcu", 7.0), (1, 2): ("mcu", 7.0), (2, 0): ("cam", 4.0), (3, 3): ("index", 100.0)}


def test_log_lines_escape_what_breaks_a_row(spark):
    df = spark.createDataFrame([(1500, "print", None, "a\tb\nc"), (0, "event", "x", "")], "t_ms long, type string, subtype string, content string")
    assert sorted(r["value"] for r in reports.log_lines(df).collect()) == ["0.000\tevent\tx\t", "1.500\tprint\t\ta\\tb\\nc"]


def test_report_holds_its_tables(spark):
    page = reports.report("a <b>", rows=spark.createDataFrame([(1, math.nan), (2, 0.5)], "k long, v double"))
    data = json.loads(re.search(r'id="rows">(.*?)</script>', page)[1])
    assert data == [{"k": 1, "v": None}, {"k": 2, "v": 0.5}] and "a &lt;b&gt;" in page


def test_report_refuses_long_tables(spark, monkeypatch):
    monkeypatch.setattr(reports, "REPORT_ROWS", 3)
    with pytest.raises(ValueError, match="more than 3 rows"):
        reports.report("t", rows=spark.range(4))


def test_cohort_tables_come_back(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "session long, v double")
    assert reports.write_cohort(str(tmp_path), {"bin": 60}, session_summary=a) == ["session_summary"]
    assert reports.read_cohort_tables(spark, str(tmp_path), ["session_summary"])["session_summary"].collect() == a.collect()
    assert json.loads(spark.read.text(str(tmp_path / "settings")).first()["value"]) == {"bin": 60}


def test_drop_counts(spark):
    d = spark.createDataFrame([("cam", 4, "full"), ("cam", 9, "full"), ("box", 1, "stale")], "stream string, frame_idx long, reason string")
    assert sorted(tuple(r) for r in reports.drop_counts(d).collect()) == [("box", "stale", 1, 1, 1), ("cam", "full", 2, 4, 9)]
