"""Shape fits on frames made from a known shape."""

import cmath
import random

import pytest
from pyspark.sql import functions as F

from burrow.operators import pose, rules

SHAPE = {"nose": 2 + 0j, "neck": 1 + 0.3j, "left": 0.2 + 1j, "right": 0.1 - 1j, "tail": -2 + 0.1j}
SCHEMA = "session long, frame long, part string, x double, y double"


def frames(rng, n=40, missing=(), wrong=()):
    rows, truth = [], {}
    for f in range(n):
        a, b = cmath.rect(rng.uniform(8, 12), rng.uniform(-3, 3)), complex(rng.uniform(50, 90), rng.uniform(50, 90))
        for part, s in SHAPE.items():
            z = a * s + b
            truth[f, part] = z
            x, y = z.real, z.imag
            if (f, part) in missing:
                x = y = None
            if (f, part) in wrong:
                x, y = x + 25, y - 20
            rows.append((1, f, part, x, y))
    return rows, truth


def test_fit_has_no_residual_and_places_missing_parts(spark):
    missing = {(f, p) for f in range(5, 40, 6) for p in ("nose", "tail")}
    rows, truth = frames(random.Random(1), missing=missing)
    points = spark.createDataFrame(rows, SCHEMA)
    shape = pose.canonical_shape(points)
    assert pose.residuals(points, shape).agg(F.max("residual")).first()[0] < 1e-6
    placed = pose.place_missing(points, shape).where("placed").collect()
    assert {(r["frame"], r["part"]) for r in placed} == missing
    assert all(abs(complex(r["x"], r["y"]) - truth[r["frame"], r["part"]]) < 1e-6 for r in placed)


def test_mistracks_go_and_nothing_else(spark):
    wrong = {(12, "nose"), (20, "left"), (33, "right")}
    rows, _ = frames(random.Random(2), wrong=wrong)
    points = spark.createDataFrame(rows, SCHEMA)
    good, _ = frames(random.Random(2))
    shape = pose.canonical_shape(spark.createDataFrame(good, SCHEMA))
    gone = pose.drop_mistracks(points, shape).where("x IS NULL").collect()
    assert {(r["frame"], r["part"]) for r in gone} == wrong


def test_side_evidence_turns_with_exchanged_parts(spark):
    rows, _ = frames(random.Random(3))
    swapped = [(s, f, {"left": "right", "right": "left"}.get(p, p) if f % 4 == 0 else p, x, y) for s, f, p, x, y in rows]
    w = pose.side_evidence(pose.wide(spark.createDataFrame(swapped, SCHEMA), list(SHAPE)), "nose", "tail", "left", "right")
    signs = {r["frame"]: r["evidence"] > 0 for r in w.collect()}
    assert len({signs[f] for f in signs if f % 4 == 0}) == 1 and all(signs[f] != signs[0] for f in signs if f % 4)
    assert pose.swap_fraction(w).first()["judged"] == 40
    low = pose.swap_fraction(w).select(pose.swap_method(F.col("swapped")).alias("m")).first()["m"]
    assert low in ("shape", "anatomical")


def test_features_and_rules(spark):
    rows = [(1, i, i * 100_000, 100_000 if i else 0, float(i if i < 20 else 20), 0.0, 10.0 + i, 0.0, float(i), 0.0, "A" if 5 <= i < 9 else "B") for i in range(40)]
    df = spark.createDataFrame(rows, "session long, frame long, t_us long, dt_us long, x double, y double, hx double, hy double, tx double, ty double, zone string")
    f = rules.features(df)
    got = {r["frame"]: r for r in f.collect()}
    assert got[0]["speed_ema"] == 0 and got[19]["speed_ema"] == pytest.approx(10, rel=0.01) and got[39]["speed_ema"] < 0.01
    assert got[10]["heading"] == 0 and got[10]["turning"] == 0 and got[10]["elongation"] == 1
    s = rules.states(f, [rules.Rule("fast", "speed_gt", 5.0), rules.Rule("still", "freezing", 1.0, duration_us=500_000), rules.Rule("out", "exit_edge", zones=("A",)), rules.Rule("unset", "speed_gt")])
    fired = {}
    for r in s.where("fired").collect():
        fired.setdefault(r["rule"], []).append(r["frame"])
    assert fired["out"] == [9] and len(fired["fast"]) == 1 and "unset" not in fired
    assert len(fired["still"]) == 1 and fired["still"][0] > 25
    with pytest.raises(ValueError):
        rules.Rule("x", "no_such").column()
