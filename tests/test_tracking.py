"""Live filters: worked properties, and streams that give what the batch scan gives, late rows included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from burrow.operators import tracking
from burrow.streaming import stateful
from burrow.streaming import tracking as live

SCHEMA = "session long, part string, frame long, t_us long, x double, y double, conf double"


@pytest.fixture(scope="module")
def stateful_spark(spark):
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in stateful.STORE:
        spark.conf.unset(k)


def walk(seed=1, parts=("nose", "tail"), sessions=3, frames=60):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for p in parts:
            x, y = rng.uniform(0, 500), rng.uniform(0, 500)
            gone = set()
            for start in range(rng.randint(0, 9), frames, 17):
                gone |= set(range(start, start + rng.choice([1, 3, 5, 6, 9])))
            for i in range(frames):
                x, y = x + rng.gauss(2, 3), y + rng.gauss(0, 3)
                seen = i not in gone
                rows.append((s, p, i, i * 33_000 + rng.randint(0, 900), x if seen else None, y if seen else None, rng.choice([0.05, 0.3, 0.9, 0.9, 0.9, None])))
    return rows


def by_part(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: (r["session"], r["part"], r["frame"])):
        out.setdefault((r["session"], r["part"]), []).append(tuple(r[c] for c in columns))
    return out


def plain_kalman(rows):
    """The same filter with matrices."""
    import numpy as np

    out, state, cov, misses, last, since = [], None, None, 0, None, None
    for t, x, y, c in rows:
        seen = None not in (x, y, c) and c >= 0.1
        if state is None:
            if seen:
                state, cov, last, since = np.array([x, y, 0.0, 0.0]), np.eye(4), c, t
                out.append((x, y, c, False))
            else:
                out.append((None, None, None, False))
            continue
        h = min(max((t - since) / 1e6, 0.001), 1.0)
        since = t
        f = np.eye(4)
        f[0, 2] = f[1, 3] = h
        one = 300.0**2 * np.array([[h**3 / 3, h**2 / 2], [h**2 / 2, h]])
        q = np.zeros((4, 4))
        q[np.ix_([0, 2], [0, 2])] = q[np.ix_([1, 3], [1, 3])] = one
        state, cov = f @ state, f @ cov @ f.T + q
        if seen:
            m = np.eye(2, 4)
            gain = cov @ m.T @ np.linalg.inv(m @ cov @ m.T + 4.0 * min(10, 1 / max(c, 0.1)) * np.eye(2))
            state, cov = state + gain @ (np.array([x, y]) - m @ state), cov - gain @ m @ cov
            misses, last = 0, c
            out.append((state[0], state[1], c, False))
            continue
        misses += 1
        out.append((state[0], state[1], last * (1 - misses / 6), True) if misses <= 5 else (None, None, None, False))
    return out


def test_points_equal_the_filter_in_matrices(spark):
    rows = walk()
    got = by_part(tracking.kept_points(spark.createDataFrame(rows, SCHEMA)).collect(), "kx", "ky", "kconf", "filled")
    for (s, p), told in got.items():
        want = plain_kalman([r[3:] for r in rows if r[:2] == (s, p)])
        assert [w[3] for w in want] == [t[3] for t in told]
        for a, b in zip(told, want):
            assert (a[0] is None) == (b[0] is None) and (a[0] is None or a[:3] == pytest.approx(b[:3], abs=1e-6))
    assert any(t[3] for v in got.values() for t in v) and any(t[0] is None for v in got.values() for t in v[20:])


def test_a_gap_is_coasted_for_five_frames_with_falling_confidence(spark):
    rows = [(1, "nose", i, i * 33_333, 100.0 + 10 * i if i < 20 or i > 26 else None, 50.0, 0.9) for i in range(30)]
    told = by_part(tracking.kept_points(spark.createDataFrame(rows, SCHEMA)).collect(), "kx", "kconf", "filled")[1, "nose"]
    assert [t[2] for t in told[19:28]] == [False] + [True] * 5 + [False] * 3
    assert [t[1] for t in told[20:25]] == pytest.approx([0.9 * (1 - m / 6) for m in range(1, 6)])
    assert told[25][0] is None and told[26][0] is None and told[27][0] is not None
    assert told[22][0] == pytest.approx(320, abs=5)  # straight on


def test_the_centre_is_lost_after_thirty_frames_and_stays(spark):
    rows = [(1, i, i * 33_333, 5.0 * i if i < 10 or i > 45 else None, 0.0 if i < 10 or i > 45 else None, math.nan if i == 5 else 0.9) for i in range(50)]
    d = tracking.centres(spark.createDataFrame(rows, "session long, frame long, t_us long, x double, y double, conf double"))
    told = d.withColumn("later", tracking.forecast("x", F.lit(50.0))).orderBy("frame").collect()
    assert [r["lost"] for r in told] == [False] * 40 + [True] * 6 + [False] * 4
    assert len({r["cx"] for r in told[39:46]}) == 1 and told[42]["vx"] == 0 and told[42]["later"] == told[42]["cx"]
    assert told[9]["later"] > told[9]["cx"] and all(r["cx"] == r["cx"] for r in told)


def stream(spark, tmp_path, batches, make, schema=SCHEMA):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(src).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.sql("SELECT * FROM told").collect()


COLUMNS = ("frame", "kx", "ky", "kconf", "filled")


def test_stream_without_late_rows_equals_the_scan_of_rows_in_time(stateful_spark, tmp_path):
    """Three micro-batches; some rows of the first come only with the third, and are left out."""
    rows = walk(2)
    late = [r for r in rows if r[2] in (7, 8, 15)]
    kept = [r for r in rows if r not in late]
    batches = [[r for r in kept if r[2] < 20], [r for r in kept if 20 <= r[2] < 40], [r for r in kept if r[2] >= 40] + late]
    for b in batches:
        random.Random(3).shuffle(b)
    got = by_part(stream(stateful_spark, tmp_path, batches, live.kept_points), *COLUMNS)
    want = by_part(tracking.kept_points(stateful_spark.createDataFrame(kept, SCHEMA)).collect(), *COLUMNS)
    assert got == want


def test_stream_that_waits_equals_the_scan_of_all_rows(stateful_spark, tmp_path):
    """Rows late by less than the watermark's span are put in order; a last row moves the watermark on."""
    rows = walk(4, sessions=2)
    early = [r for r in rows if r[2] < 20 and r[2] not in (12, 17)]
    middle = [r for r in rows if 20 <= r[2] < 40 or r[2] == 17]
    rest = [r for r in rows if r[2] >= 40 or r[2] == 12]
    end = [(99, "nose", 0, 10**9, 1.0, 1.0, 0.9)]
    batches = [early, middle, rest, end]
    for b in batches:
        random.Random(5).shuffle(b)
    got = by_part(stream(stateful_spark, tmp_path, batches, lambda s: live.kept_points(s, late="2 seconds")), *COLUMNS)
    got.pop((99, "nose"), None)
    assert got == by_part(tracking.kept_points(stateful_spark.createDataFrame(rows, SCHEMA)).collect(), *COLUMNS)


def test_centres_in_a_stream(stateful_spark, tmp_path):
    rows = [r for r in walk(6, parts=("body",)) if r[6] is not None]
    batches = [[r for r in rows if r[2] % 60 // 20 == k] for k in range(3)]
    columns = ("frame", "cx", "cy", "vx", "vy", "ax", "ay", "lost")
    told = stream(stateful_spark, tmp_path, batches, lambda s: live.centres(s, keys=("session", "part")))
    want = tracking.centres(stateful_spark.createDataFrame(rows, SCHEMA), keys=("session", "part")).collect()
    assert by_part(told, *columns) == by_part(want, *columns)
