"""The whole chains on an animal whose truth is known, step by step against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_repair import AXIS, PAIRS, PARTS, back, crossed, frame, trace

from burrow.operators import chain, clean, repair

HOW = chain.Chain(tuple(PARTS), tuple((PARTS[i], PARTS[j]) for i, j in PAIRS), (PARTS[AXIS[0]], PARTS[AXIS[1]]), ("snout", "center"), body_part="center", max_speed=2000.0)


def points(spark, z, conf=None):
    df = frame(spark, {1: z})
    p = repair.pointed(df, PARTS)
    return p if conf is None else p.join(conf, ["session", "frame", "part"], "left").withColumn("conf", F.coalesce("low", "conf")).drop("low")


def swapped_ends(seen, rows):
    out = seen.copy()
    out[np.ix_(rows, [0, 3])] = out[np.ix_(rows, [3, 0])]
    return out


def test_anchor_is_the_part_that_tells_head_from_body(spark):
    _, seen = trace(100, 2)
    row = chain.swap_anchors(frame(spark, {1: seen}), len(PARTS), (0, 3)).first()
    d = lambda a, b: np.nanmedian(abs(seen[:, a] - seen[:, b])[~np.isnan(seen[:, 0] + seen[:, 3] + seen[:, b])])
    ratios = {i: max(d(0, i), d(3, i)) / min(d(0, i), d(3, i)) for i in range(7) if i not in (0, 3)}
    best = max(ratios, key=ratios.get)
    assert row["anchor"] == best and row["head_farther"] == (d(0, best) > d(3, best))


def test_crossed_ends_are_resolved(spark):
    truth, seen = trace(150, 3, 0.0)
    rows = np.arange(50, 95)
    out = chain.ends_resolved(frame(spark, {1: swapped_ends(seen, rows)}), HOW)
    assert np.allclose(back(out, 1), seen)
    assert [r["crossed"] for r in out.orderBy("frame").collect()] == [50 <= i < 95 for i in range(150)]


def test_corrected_points_are_near_the_truth(spark):
    """Swapped sides, crossed ends, thrown and weak detections at once; nothing is told as seen that was computed."""
    truth, seen = trace(240, 4, 0.05)
    rng = np.random.default_rng(5)
    raw = swapped_ends(crossed(seen, np.arange(60, 75)), np.arange(120, 150))
    weak = [(1, int(f), PARTS[int(p)], 0.2) for f, p in zip(rng.integers(0, 240, 60), rng.integers(0, 7, 60))]
    df = points(spark, raw, spark.createDataFrame(list(dict.fromkeys(weak)), "session long, frame long, part string, low double"))
    out = repair.framed(chain.corrected_points(df, HOW), PARTS).orderBy("frame")
    z = back(out, 1)
    off = abs(z - truth)
    assert np.isnan(z).mean() < 0.01 and np.nanmedian(off) < 1.0 and np.nanpercentile(off, 99) < 6


def test_track_of_the_followed_part(spark):
    truth, seen = trace(240, 6, 0.05)
    seen[100, 3] += 900  # a teleport
    track = chain.built_track(points(spark, seen), HOW).orderBy("frame").collect()
    x = np.array([np.nan if r["x"] is None else r["x"] + 1j * r["y"] for r in track])
    assert len(track) == 240 and np.nanmedian(abs(x - truth[:, 3])) < 6 and np.nanmax(abs(x - truth[:, 3])) < 30
    assert sum(r["step"] for r in track) == pytest.approx(abs(np.diff(truth[:, 3])).sum(), rel=0.15)
    assert all(r["speed"] == pytest.approx(r["step"] * 1e6 / r["dt_us"]) for r in track[1:]) and track[0]["speed"] == 0


def test_without_cleaning_the_chain_is_gate_mean_and_steps(spark):
    _, seen = trace(30, 7, 0.2)
    plain = chain.Chain(tuple(PARTS), swap_correct=False, refine=False, smooth=False, max_speed=1e9)
    track = chain.built_track(points(spark, seen), plain).orderBy("frame").collect()
    want = np.nanmean(seen, 1)
    assert np.allclose([r["x"] + 1j * r["y"] for r in track], want) and np.allclose([r["step"] for r in track][1:], abs(np.diff(want)))


def test_a_held_teleport_keeps_the_place_before(spark):
    rows = [(1, i, "p", 100_000 if i else 0, x, 0.0) for i, x in enumerate([0.0, 1.0, 90.0, 180.0, 181.0, None, 5.0])]
    df = spark.createDataFrame(rows, "session long, frame long, part string, dt_us long, x double, y double")
    held = clean.teleport_gate(df, 100.0, parts=("part",), hold=True).orderBy("frame").collect()
    assert [r["x"] for r in held] == [0.0, 1.0, 1.0, 1.0, 181.0, None, 5.0]


def test_zero_lag_keeps_holes_and_parabolas(spark):
    rows = [(1, i, "p", None if i in (5, 9) else float(3 + 2 * i)) for i in range(14)]
    got = clean.zero_lag(spark.createDataFrame(rows, "session long, frame long, part string, x double"), "x", ("part",)).orderBy("frame").collect()
    assert [r["x"] is None for r in got] == [i in (5, 9) for i in range(14)]
    assert [r["x"] for r in got if r["x"] is not None and 3 <= r["frame"] < 11] == pytest.approx([3 + 2 * i for i in range(3, 11) if i not in (5, 9)])
