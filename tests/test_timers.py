"""Streams that act on time and forget give what their batch twins give; silent sessions alarm without a row."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_tracking import stateful_spark, stream  # noqa: F401

from burrow.operators import clean, events, joins, live
from burrow.streaming import logs, timers

SCHEMA = "session long, frame long, t_us long, name string"
SECOND = 1_000_000


def messages(seed=1, sessions=5, n=120):
    """Names with starts and stops; no session ends while it runs."""
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        t = rng.randint(0, SECOND)
        for i in range(n):
            t += rng.choice([20_000, 130_000, 700_000, 2_600_000])
            rows.append((s, i, t, "stop" if i == n - 1 else rng.choice(["start", "stop", "lick left", "lick right", "poke", "reward", "reward", None])))
    return rows


def parts(rows, count=3):
    """By time, each part shuffled."""
    rows = sorted(rows, key=lambda r: r[2])
    cut = -(-len(rows) // count)
    out = [rows[i : i + cut] for i in range(0, len(rows), cut)]
    for p in out:
        random.Random(7).shuffle(p)
    return out


def plain(rows):
    return sorted(tuple(r) for r in rows if r["session"] != 99)


END = (99, 0, 10**10, None)


def run_marks():
    return F.col("name") == "start", F.col("name") == "stop"


COUNTERS = {"licks": "lick", "rewards": "reward"}


def test_counters_of_a_run_are_dropped_by_its_reset(stateful_spark, tmp_path):
    rows = messages()
    args = (F.col("name") == "start", COUNTERS, {"wait": ("poke", "reward")}, {"L": "lick left", "R": "lick"})
    want = live.run_messages(stateful_spark.createDataFrame(rows, SCHEMA), *args)
    assert plain(stream(stateful_spark, tmp_path, parts(rows), lambda s: timers.run_messages(s, *args), SCHEMA)) == plain(want.collect())
    assert want.where("kind = 'latency'").count() > 5 and want.agg(F.max("run")).first()[0] > 5


def test_ticks_of_running_sessions(stateful_spark, tmp_path):
    rows = messages(2)
    want = live.ticks(stateful_spark.createDataFrame(rows, SCHEMA), COUNTERS, *run_marks(), SECOND)
    told = stream(stateful_spark, tmp_path, [*parts(rows), [END]], lambda s: timers.ticks(s, COUNTERS, *run_marks(), SECOND, late="0 seconds"), SCHEMA)
    assert plain(told) == plain(want.collect()) and len(told) > 100
    shares = events.calculated(want, {"share": "rewards / licks"}).collect()
    assert all(r["share"] == (r["rewards"] / r["licks"] if r["licks"] else 0) for r in shares)


def test_ticks_by_hand(spark):
    rows = [(1, 0, 500_000, "lick"), (1, 1, SECOND, "start"), (1, 2, 2 * SECOND, "lick"), (1, 3, 3 * SECOND, "lick"), (1, 4, 4_200_000, "stop"), (1, 5, 9 * SECOND, "lick")]
    got = live.ticks(spark.createDataFrame(rows, SCHEMA), {"n": "lick"}, *run_marks(), SECOND)
    assert sorted(map(tuple, got.collect())) == [(1, 2 * SECOND, 0), (1, 3 * SECOND, 1), (1, 4 * SECOND, 2)]


def test_stalls_on_the_clock_of_the_rows(stateful_spark, tmp_path):
    rows = [r for r in messages(3) if r[0] != 2 or r[1] < 60]  # one session falls silent
    want = live.stall_edges(stateful_spark.createDataFrame(rows, SCHEMA), 2 * SECOND, END[2])
    told = stream(stateful_spark, tmp_path, [*parts(rows), [END]], lambda s: timers.stalls(s, 2 * SECOND, late="0 seconds"), SCHEMA)
    assert plain(told) == plain(want.collect()) and len([r for r in told if r["event"] == "recovered"]) > 20


def test_a_silent_session_alarms_without_any_row(stateful_spark, tmp_path):
    """On the processing clock: one file comes, and nothing after it."""
    spark = stateful_spark
    spark.createDataFrame([(1, 0, 5, "a"), (2, 0, 7, "a")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = timers.stalls(src, 2 * SECOND).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.sql("SELECT * FROM silent").count() < 2:
            assert q.exception() is None
            time.sleep(0.5)
        assert sorted(map(tuple, spark.sql("SELECT * FROM silent").collect())) == [(1, 5 + 2 * SECOND, "stalled"), (2, 7 + 2 * SECOND, "stalled")]
        spark.createDataFrame([(1, 1, 9 * SECOND, "a")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        while time.time() < until and spark.sql("SELECT * FROM silent").count() < 4:
            time.sleep(0.5)
        told = [tuple(r) for r in spark.sql("SELECT * FROM silent WHERE session = 1").collect()]
        assert told == [(1, 5 + 2 * SECOND, "stalled"), (1, 9 * SECOND, "recovered"), (1, 11 * SECOND, "stalled")]
    finally:
        q.stop()


@pytest.mark.parametrize("seed", [4, 5])
def test_frames_are_closed_by_the_next_one(stateful_spark, tmp_path, seed):
    """Frames and notes in any order within the watermark: what a batch folds together."""
    rng = random.Random(seed)
    frames = [(s, i, i * 100_000 + rng.randint(0, 90_000), None) for s in range(4) for i in range(40)]
    notes = [(s, i, rng.choice([rng.randint(0, 4 * SECOND), rng.choice(frames)[2]]), f"note {i}") for s in range(4) for i in range(60)]
    both = sorted(frames + notes, key=lambda r: r[2] + rng.randint(0, 900_000))
    cut = -(-len(both) // 4)
    batches = [*(both[i : i + cut] for i in range(0, len(both), cut)), [(99, 0, 10**9, None)]]
    told = stream(stateful_spark, tmp_path, batches, lambda s: timers.folded(s.where("name IS NULL"), s.where("name IS NOT NULL"), "name", "frame", "1 second", close_us=SECOND), SCHEMA)
    spark = stateful_spark
    want = joins.folded(spark.createDataFrame([r[:3] for r in frames], "session long, frame long, t_us long"), spark.createDataFrame(notes, SCHEMA), "t_us", "name", "frame")
    assert plain(told) == sorted((r["session"], r["frame"], r["t_us"], r["names"]) for r in want.collect())


def test_the_frame_log_is_folded_clamped_and_summed(stateful_spark, tmp_path):
    """What the stream writes is what the batch twins give; its totals count clamps, new seats, poses and losses."""
    spark = stateful_spark
    rng = random.Random(8)
    frames, clock = [], {}
    for s in range(3):
        clock[s] = 1000.0
        for i in range(60):
            clock[s] += rng.choice([30.0, 40.0, -60.0, -900.0]) if rng.random() < 0.3 else 35.0
            frames.append((s, i, i * 100_000 + rng.randint(0, 50_000), None if s == 2 or rng.random() < 0.1 else clock[s], s != 1 and rng.random() < 0.7))
    notes = [(s, i, rng.randint(0, 6 * SECOND), f"n{i}") for s in range(3) for i in range(40)]
    schema, note_schema = "session long, frame long, t_us long, fw_ms double, has_pose boolean", "session long, ord long, t_us long, name string"
    both = sorted([("f", r) for r in frames] + [("n", r) for r in notes], key=lambda x: x[1][2] + rng.randint(0, 800_000))
    cut = -(-len(both) // 3)
    for i in range(0, len(both), cut):
        part = both[i : i + cut]
        spark.createDataFrame([r for k, r in part if k == "f"], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        spark.createDataFrame([r for k, r in part if k == "n"], note_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "n"))
    spark.createDataFrame([(99, 0, 10**9, 1.0, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    spark.createDataFrame([(99, 0, 10**9, "x")], note_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "n"))
    read = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    rows = logs.frame_rows(read("f", schema), read("n", note_schema), "name", "ord", "1 second", close_us=SECOND)
    q = logs.write_rows(rows, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).where("session <> 99")
    df = spark.createDataFrame(frames, schema)
    want = clean.forward_clock(df, "fw_ms", "clock", logs.MOST_BACK_MS).join(joins.folded(df.select("session", "frame", "t_us"), spark.createDataFrame(notes, note_schema).withColumnRenamed("ord", "frame"), "t_us", "name", "frame").select("session", "frame", "names"), ["session", "frame"])
    columns = ("session", "frame", "t_us", "fw_ms", "has_pose", "names")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted((r["session"], r["frame"], r["t_us"], r["clock"], r["has_pose"], r["names"]) for r in want.collect())
    drops = spark.createDataFrame([(0,), (0,)], "session long")
    trackers = spark.createDataFrame([(0, "pose"), (1, "pose"), (2, "none")], "session long, tracker string")
    told = {r["session"]: r for r in logs.totals(got, drops, trackers).collect()}
    assert [told[s]["frames"] for s in range(3)] == [60] * 3 and told[0]["dropped"] == 2 and told[1]["dropped"] == 0
    assert told[0]["clamps"] > 0 and told[0]["reseats"] > 0 and [told[s]["warnings"] for s in range(3)] == [[], ["no_pose"], ["no_time"]]


def test_the_event_log_is_written_as_lines(spark, tmp_path):
    kind = "t_ms long, type string, subtype string, content string"
    spark.createDataFrame([(1500, "print", "task", "a\tb"), (20, "state", None, "run")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = logs.write_events(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(60)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0.020\tstate\t\trun", "1.500\tprint\ttask\ta\\tb"]
