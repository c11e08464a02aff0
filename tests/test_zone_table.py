"""Rasters against a test of every pixel, legacy edges on turned boxes, and confirmed interaction frame by frame."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burrow.operators import raster, zone_table
from burrow.plans import interaction

ZONES = "name string, ord int, points array<struct<x:double,y:double>>"


def inside(points, x, y):
    """Even-odd, and on the border."""
    odd, border = False, False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
        n = max(abs(bx - ax), abs(by - ay))
        for k in range(int(n) + 1):
            u = k / n if n else 0
            border |= (math.floor(ax + u * (bx - ax) + 0.5), math.floor(ay + u * (by - ay) + 0.5)) == (x, y)
    return odd or border


@pytest.mark.parametrize("seed", range(6))
def test_filled_is_a_test_of_every_pixel(seed):
    rng = random.Random(seed)
    points = [(rng.randint(-5, 45), rng.randint(-5, 35)) for _ in range(rng.randint(3, 8))]  # crossing itself, too
    got = raster.filled(np.array(points), 40, 30)
    assert got.tolist() == [[inside(points, x, y) for x in range(40)] for y in range(30)]


def test_looked_up_points(spark):
    zones = {"big": [(2.0, 2.0), (30.4, 2.0), (30.4, 20.0), (2.0, 20.0)], "small": [(4.6, 4.0), (10.0, 4.0), (7.0, 15.0)], "line": [(0.0, 0.0), (5.0, 5.0)]}
    z = spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(zones.items())], ZONES)
    points = [(0, 4.6, 4.4), (1, 7.0, 12.5), (2, 30.4, 20.4), (3, 30.6, 20.0), (4, -0.4, 3.0), (5, -0.6, 3.0), (6, None, 3.0), (7, 99.5, 10.0), (8, float("nan"), 1.0)]
    got = {r["i"]: r["held"] for r in raster.looked_up(spark.createDataFrame(points, "i int, x double, y double"), z, 100, 30).collect()}
    assert got == {0: ["big"], 1: ["small", "big"], 2: ["big"], 3: [], 4: [], 5: [], 6: [], 7: [], 8: []} | {0: ["small", "big"] if inside([(5, 4), (10, 4), (7, 15)], 5, 4) else ["big"]}


def test_the_outermost_edge_of_turned_boxes(spark):
    rows = []
    for i in range(60):
        t, far = math.radians(i * 6.3), (120.0, 40.0)
        corner = lambda x, y: (far[0] + math.cos(t) * x - math.sin(t) * y, far[1] + math.sin(t) * x + math.cos(t) * y)  # noqa: B023, E731
        rows.append((str(i), i, [corner(-20, -5), corner(20, -5), corner(20, 5), corner(-20, 5)], 0.0, 0.0))
    rows.append(("none", 60, [(1.0, 1.0), (1.0, 1.0)], 0.0, 0.0))
    got = {r["ord"]: r["edge"] for r in zone_table.outermost_edges(spark.createDataFrame(rows, ZONES + ", cx double, cy double")).collect()}
    assert got.pop(60) is None
    for i, e in got.items():
        (ax, ay), (bx, by) = e["a"], e["b"]
        assert math.hypot(bx - ax, by - ay) == pytest.approx(40)
        other = (240 - (ax + bx) / 2, 80 - (ay + by) / 2)  # the middle of the side across
        assert math.hypot((ax + bx) / 2, (ay + by) / 2) >= math.hypot(*other) - 1e-9


def test_targets(spark):
    at = lambda x, y: [(x - 1.0, y - 1.0), (x + 1.0, y - 1.0), (x + 0.0, y + 2.0)]
    zones = {"Social_IA": at(0, 0), "Social": at(90, 90), "Object_1_IA": at(10, 0), "big-object_1": at(50, 0), "object-2": at(11, 0), "Lone_IA": at(40, 40), "far": at(45, 45)}
    z = spark.createDataFrame([(n, i, p) for i, (n, p) in enumerate(zones.items())], ZONES)
    assert {r["name"]: r["target"] for r in zone_table.targets(z).collect()} == {"Social_IA": "Social", "Object_1_IA": "big-object_1", "Lone_IA": "far"}
    alone = spark.createDataFrame([("A_IA", 0, at(0, 0)), ("B_IA", 1, at(5, 5))], ZONES)
    assert {r["name"]: r["target"] for r in zone_table.targets(alone).collect()} == {"A_IA": "A_IA", "B_IA": "B_IA"}


def test_confirmed_interaction_frame_by_frame(spark):
    """The latch by hand: in the zone long enough, then facing long enough after the first facing frame."""
    z = interaction.layout(spark)
    ends = interaction._lines()["Social_IA"]
    lines = zone_table.reference_lines(z, inner=20.0)
    got = {r["name"]: (*r["outer"]["a"], *r["outer"]["b"], *r["on"], *r["normal"]) for r in lines.collect()}
    assert set(got) == set(interaction._lines()) and all(got[n] == pytest.approx(v) for n, v in interaction._lines().items())
    rng = random.Random(4)
    rows, ms = [], 0.0
    for i in range(400):
        dt = rng.choice([30.0, 60.0, 90.0])
        ms += dt
        hx, hy = rng.choice([(10.0, 10.0), (30.0, 20.0), (100.0, 35.0), (300.0, 50.0)]) if rng.random() < 0.15 or not rows else rows[-1][6:8]
        bx, by = hx + rng.choice([5.0, -5.0, 0.0]), hy + rng.choice([5.0, -5.0])
        zone = "Social_IA" if hx < 120 else None
        rows.append((1, i, ms, dt * 1000, bx, by, hx, hy, zone))
    d = spark.createDataFrame(rows, "session long, frame long, t_ms double, dt_us double, x double, y double, hx double, hy double, head_zone string")
    told = zone_table.confirmed_interaction(d, lines, ["Social_IA"], ("session",), 100.0, 45.0).orderBy("frame").collect()
    ax, ay, bx, by, ox, oy, nx, ny = ends
    lasted, since, was = 0.0, None, False
    for r in told:
        near = r["head_zone"] == "Social_IA" and (r["hx"] - ox) * nx + (r["hy"] - oy) * ny <= 0
        lasted = lasted + r["dt_us"] / 1000 if near else 0.0
        ok = near and lasted >= 100
        u = min(max(((r["hx"] - ax) * (bx - ax) + (r["hy"] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0), 1)
        v, w = (r["hx"] - r["x"], r["hy"] - r["y"]), (ax + u * (bx - ax) - r["hx"], ay + u * (by - ay) - r["hy"])
        angle = math.degrees(math.acos(max(-1, min(1, (v[0] * w[0] + v[1] * w[1]) / (math.hypot(*v) * math.hypot(*w))))))
        face = ok and angle <= 45
        now = face and since is not None and r["t_ms"] - since >= 100
        since = (r["t_ms"] if since is None else since) if face else None
        assert (r["confirmed_0"], r["facing_0"], r["entered_0"]) == (ok, face, now and not was), r["frame"]
        was = now
    assert sum(r["entered_0"] for r in told) >= 3


def test_the_wide_table_has_its_columns(spark):
    rows = [(1, i, 100.0 * i, "CenterZone" if i % 9 < 6 else None, "run" if i < 50 else None, 200.0 + i, 50.0, 30.0, 20.0, "m1") for i in range(60)]
    d = spark.createDataFrame(rows, "session long, frame long, t_ms double, zone string, state string, x double, y double, hx double, hy double, MouseID string")
    out = zone_table.zone_table(d, interaction.layout(spark), list(interaction.LAYOUT), 0.01, inner=20.0)
    assert out.columns[1:64] == list(zone_table.COLUMNS) and len(zone_table.COLUMNS) == len(set(zone_table.COLUMNS))
    r = out.first()
    assert out.count() == 1 and (r["MouseID"], r["State"], r["Bin"], r["StateDur_s"]) == ("m1", "run", "", 5)
    assert r["Center_entries_body"] == 6 and r["Center_time_body"] == pytest.approx(3.4) and r["Distance_m"] == pytest.approx(0.49)
    assert r["Distance_Center_m"] == pytest.approx(0.01 * sum(i % 9 in range(1, 6) for i in range(1, 50)))


@pytest.mark.parametrize("seconds,want", [(60, "2-3min"), (120, "4-6min"), (30, "60-90s"), (0.5, "1-1.5s"), (90, "180-270s")])
def test_bin_labels(spark, seconds, want):
    assert spark.range(1).select(zone_table.bin_label(F.lit(2).cast("long"), float(seconds)).alias("b")).first()["b"] == want
