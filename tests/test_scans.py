"""Recursive filters against plain loops, and window gates on small series."""

import math
import random

import pytest

from burrow.operators import clean


def series_rows(seed=1, sessions=5):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        t = 0
        for i in range(rng.randint(1, 60)):
            t += rng.choice([0, 20_000, 33_000, 40_000])
            v = None if rng.random() < 0.15 else rng.gauss(50, 10)
            rows.append((s, i, t, 33_000 if i else 0, v, 5.0, rng.choice([None, 0.2, 0.9])))
    return rows


SCHEMA = "session long, frame long, t_us long, dt_us long, x double, y double, conf double"


def by_session(df, column):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["session"], r["frame"])):
        out.setdefault(r["session"], []).append(r[column])
    return out


def loop_one_euro(t, v):
    out, p = [], None
    for ti, x in zip(t, v):
        if x is None:
            out.append(None)
            continue
        if p is None:
            p = (x, 0.0, ti)
            out.append(x)
            continue
        gap = (ti - p[2]) / 1e6
        if gap <= 0:
            out.append(p[0])
            continue
        a = lambda c: 2 * math.pi * c * gap / (2 * math.pi * c * gap + 1)
        d = a(1.0) * (x - p[0]) / gap + (1 - a(1.0)) * p[1]
        c = a(1.0 + 0.007 * abs(d))
        p = (c * x + (1 - c) * p[0], d, ti)
        out.append(p[0])
    return out


def test_one_euro(spark):
    rows = series_rows()
    got = by_session(clean.one_euro(spark.createDataFrame(rows, SCHEMA), "x", "o"), "o")
    for s, o in got.items():
        own = [r for r in rows if r[0] == s]
        assert o == pytest.approx(loop_one_euro([r[2] for r in own], [r[4] for r in own]), nan_ok=True)


def test_two_state_path(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.uniform(-1, 1)) for s in range(20) for i in range(rng.randint(1, 9))]
    got = by_session(clean.two_state_path(spark.createDataFrame(rows, "session long, frame long, e double"), "e", "swap"), "swap")
    for s, path in got.items():
        ev = [r[2] for r in rows if r[0] == s]
        cost = lambda p: sum(max(0, e if on else -e) for e, on in zip(ev, p)) + 0.15 * sum(a != b for a, b in zip(p, p[1:]))
        best = min(cost([bool(m >> i & 1) for i in range(len(ev))]) for m in range(1 << len(ev)))
        assert cost(path) == pytest.approx(best)


def test_forward_clock(spark):
    rows = [(1, i, float(t)) for i, t in enumerate([1000, 1100, 1050, 1200, 700, 720, 710])]
    got = by_session(clean.forward_clock(spark.createDataFrame(rows, "session long, frame long, t double"), "t", "m"), "m")[1]
    assert got == [1000, 1100, 1100, 1200, 700, 720, 720]


def test_held_clamp_keeps_the_corrected_place(spark):
    rows = [(1, i, 100_000, x, 0.0) for i, x in enumerate([0.0, 1.0, 90.0, 2.0, None, 3.0])]
    got = by_session(clean.held_clamp(spark.createDataFrame(rows, "session long, frame long, dt_us long, x double, y double"), 100.0), "clamped_x")[1]
    assert got == [0.0, 1.0, 1.0, 2.0, None, 3.0]


def test_smoother_is_nearer_the_truth_than_the_data(spark):
    rng = random.Random(2)
    truth = [50 + 30 * math.sin(i / 25) for i in range(400)]
    rows = [(1, i, i * 33_000, 33_000 if i else 0, None if i % 37 == 5 else v + rng.gauss(0, 2), 0.0, 0.9) for i, v in enumerate(truth)]
    df = clean.process_variance(spark.createDataFrame(rows, SCHEMA), "x", "y", 2.0)
    got = by_session(clean.rts(df, "x", "s", conf="conf"), "s")[1]
    error = lambda v: sum(abs(a - b) for a, b in zip(v, truth) if a is not None)
    assert [g is None for g in got] == [r[4] is None for r in rows]
    assert error(got) < 0.8 * error([r[4] for r in rows])


def test_crossed_pairs_follow_a_lasting_exchange(spark):
    rows = []
    for i in range(30):
        a, b = (float(i), 0.0), (i + 40.0, 0.0)
        if 10 <= i < 20:
            a, b = b, a
        rows.append((1, i, *a, *b))
    got = by_session(clean.crossed_pairs(spark.createDataFrame(rows, "session long, frame long, ax double, ay double, bx double, by double")), "crossed")[1]
    assert got == [10 <= i < 20 for i in range(30)]


def test_gap_fill(spark):
    rows = [(1, i, i * 100_000, v) for i, v in enumerate([None, 0.0, None, 2.0, None, None, None, None, 7.0, None])]
    df = spark.createDataFrame(rows, "session long, frame long, t_us long, x double")
    assert by_session(clean.fill_gaps(df, 250_000, "t_us", "x"), "x")[1] == [None, 0.0, 1.0, 2.0, None, None, None, None, 7.0, None]


def test_savgol_keeps_a_parabola(spark):
    rows = [(1, i, float(i * i)) for i in range(12)]
    got = by_session(clean.savgol(spark.createDataFrame(rows, "session long, frame long, x double"), "x", "s"), "s")[1]
    assert got[3:9] == pytest.approx([i * i for i in range(3, 9)]) and None not in got
