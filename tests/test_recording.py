"""The ladder of clocks rung by rung, spaces, scales and the ladder of folders."""

import pytest
from pyspark.sql import functions as F

from burrow.functions import scalars
from burrow.operators import clocks, rules
from burrow.sources import catalog

TIMES = "session long, frame long, t_ms double"


def times(spark, **series):
    return spark.createDataFrame([(int(s[1:]), i, t) for s, ts in series.items() for i, t in enumerate(ts)], TIMES)


def test_every_rung_of_the_ladder(spark):
    steady = [40.0 * i for i in range(30)]
    recorded = times(spark, s1=steady, s2=[0.0, 100.0, 50.0, 150.0], s3=[7.0], s8=[None, 0.0, None, 2.0])
    stamps = times(spark, s1=[0.0, 1.0], s3=steady, s4=[0.0] * 9, s5=[10.0 * i * i for i in range(20)], s6=steady)
    rows = [(1, 25.0, 30, 25.0), (2, None, None, None), (3, 30.0, 30, 10.0), (4, 30.0, 9, None), (5, 12.0, 20, None), (6, 30.0, None, 25.0), (7, 30.0, 5, 60.0), (8, 30.0, 5, None), (9, None, None, 25.0), (10, None, None, None)]
    sessions = spark.createDataFrame(rows, "session long, container_fps double, container_frames long, user_fps double")
    got = {r["session"]: (r["source"], round(r["fps"], 2), r["vfr"], set(r["warnings"])) for r in clocks.clock_models(sessions, recorded, stamps).collect()}
    assert got == {
        1: ("recorded", 25.0, False, set()),
        2: ("recorded", 10.0, False, {"backward"}),
        3: ("container_pts", 25.0, False, {"user_differs"}),
        4: ("container_fps", 30.0, False, {"no_times", "no_stamps"}),
        5: ("container_pts", 5.26, True, {"no_times"}),
        6: ("user", 25.0, False, {"no_times"}),
        7: ("user", 60.0, False, {"no_times", "no_stamps", "user_overrides"}),
        8: ("recorded", 500.0, False, {"implausible", "count_differs"}),
        9: ("user", 25.0, False, {"no_times"}),
        10: ("index", 0.0, False, {"no_times", "no_rate"}),
    }


def test_recorded_zones_stay_where_spaces_differ(spark):
    rows = [(s, i, x, 10.0, z) for s, x, z in ((1, 50.0, "a"), (2, 900.0, "a"), (3, 900.0, "na"), (4, 900.0, "a"), (5, None, "a")) for i in range(5)]
    f = spark.createDataFrame(rows, "session long, frame long, x double, y double, location string").withColumn("computed", F.lit("new"))
    spaces = spark.createDataFrame([(s, 100.0, 100.0, s == 4) for s in range(1, 6)], "session long, width double, height double, edited boolean")
    got = {r["session"]: r["zone"] for r in clocks.rezoned(f, clocks.rezoning(f, spaces), "computed").collect()}
    assert got == {1: "new", 2: "a", 3: "new", 4: "new", 5: "new"}


@pytest.mark.parametrize("scale,meta,want", [('{"pix_per_cm": "12"}', None, 0.01 / 12), ("[0, 0, 3, 4]", "9", 0.01 * 22 / 5), ('{"length": 10, "values": [[0, 0], [30, 40]]}', None, 0.002), (None, "20", 0.0005), ("{}", None, 1.0), ("broken", None, 1.0), ("0", "0", 1.0), ("-3", None, 1.0)])
def test_scales(spark, scale, meta, want):
    assert spark.range(1).select(scalars.m_per_px(F.lit(scale).cast("string"), F.lit(meta).cast("string")).alias("m")).first()["m"] == pytest.approx(want)


def test_nearer_data_folders_go_first(spark):
    projects = spark.createDataFrame([("/r/exp/p", ["p", "short"]), ("/r/exp/q", ["q"]), ("/s/x", ["x"])], "project string, names array<string>")
    paths = ["/r/data/short/010101/a.tsv", "/r/data/020202/b.tsv", "/r/exp/data/other/030303/c.tsv", "/r/exp/q/data/040404/video/d_video_data.txt", "/r/exp/q/data/040404/notes.txt", "/s/data/050505/mcu/e.tsv", "/s/data/060606/e.tsv", "/s/data/06/e.tsv"]
    got = catalog.recordings(projects, spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string")).collect()
    assert {(r["project"], r["path"], r["kind"], r["tier"]) for r in got} == {("/r/exp/p", paths[0], "mcu", 0), ("/r/exp/q", paths[3], "video", 1), ("/s/x", paths[5], "mcu", 1), ("/s/x", paths[6], "mcu", 1)}
    assert len(got) == 4
    lone = spark.createDataFrame([("/r/exp/z", ["z"])], "project string, names array<string>")
    files = spark.createDataFrame([("/r/exp/data/other/030303/c.tsv",), ("/r/data/more/010101/a.tsv",)], "path string")
    assert [(r["path"], r["tier"]) for r in catalog.recordings(lone, files).collect()] == [("/r/exp/data/other/030303/c.tsv", 2)]


def test_policies_become_rules(spark):
    z = spark.createDataFrame([("a", "event_enter_exit", None, "in", "out"), ("b", None, "spot_x", None, None), ("c", "event_enter", "", "go", "gone"), ("d", "typo", "v", "x", "y")], "name string, transmit_mode string, coord_var string, event_on_enter string, event_on_exit string")
    p = rules.zone_policies(z, "nose")
    assert {(r["name"], r["kind"], r["target"], r["carries_pixels"]) for r in p.collect()} == {("a", "event", "in", False), ("a", "event", "out", False), ("b", "coordinate", "spot_x", True), ("c", "event", "go", False)}
    assert [(r.name, r.condition, r.zones) for r in rules.rules_of(p)] == [("out", "exit_edge", ("a",)), ("in", "in_zone", ("a",)), ("go", "in_zone", ("c",))]
    assert rules.zone_policies(z, coordinates=False, events=False).isEmpty()
