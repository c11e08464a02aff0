"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from burrow.operators import events, series
from burrow.streaming import rules

SCHEMA = "session long, frame long, t_us long, zone string, name string, speed double"


def run(spark, tmp_path, make, mode="append"):
    rows = [(s, i, i * 100_000, "abc"[(i * (s + 2)) % 3], f"{'xyz'[(i + s) % 3]} {i}", float((i * 7 + s) % 10)) for s in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):  # three files, each a micro-batch, in order
        df.where(f"frame % 40 >= {k * 14} AND frame % 40 < {(k + 1) * 14}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("streamed").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df, sorted(map(tuple, spark.sql("SELECT * FROM streamed").collect()))


def test_edges(spark, tmp_path):
    df, got = run(spark, tmp_path, lambda s: rules.edges(s, F.col("speed") > 4))
    want = series.rising(df, F.col("speed") > 4).where("fired").select("session", "frame", "t_us")
    assert got == sorted(map(tuple, want.collect()))


def test_latencies(spark, tmp_path):
    df, got = run(spark, tmp_path, lambda s: rules.latencies(s, F.col("zone") == "a", F.col("zone") == "c"))
    want = events.latencies(df, F.col("zone") == "a", F.col("zone") == "c")
    assert got == sorted(map(tuple, want.collect()))


def test_changes(spark, tmp_path):
    df, got = run(spark, tmp_path, lambda s: rules.changes(s, "zone"))
    want = events.changed_only(df.select("session", "frame", "zone"), "zone")
    assert got == sorted(map(tuple, want.collect()))


def test_sequence(spark, tmp_path):
    df, got = run(spark, tmp_path, lambda s: rules.alternating(s, {"X": "x", "Z": "z"}))
    want = {r["session"]: r["sequence"] for r in events.sequences(df, {"X": "x", "Z": "z"}).collect()}
    seq = {}
    for s, _, n, token in sorted(got, key=lambda r: (r[0], r[2])):
        seq.setdefault(s, []).append(token)
    assert seq == want


def test_late_rows_change_nothing(spark, tmp_path):
    rows = [(0, [(1, 0, 1.0), (1, 10, 9.0), (1, 20, 9.0)]), (1, [(1, 5, 1.0), (1, 30, 9.0)]), (2, [(1, 40, 1.0), (1, 50, 9.0)])]
    for k, part in rows:
        spark.createDataFrame([(s, t, t, "a", "n", v) for s, t, v in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rules.edges(src, F.col("speed") > 4).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["frame"] for r in spark.sql("SELECT * FROM late").collect()) == [10, 50]


def test_zone_changes(spark, tmp_path):
    df, got = run(spark, tmp_path, lambda s: rules.zone_changes(s.withColumn("zones", F.when(F.col("frame") % 4 == 0, "a").otherwise(F.concat(F.lit("a|"), F.col("zone")))), "zones"))
    want, was = [], {}
    for r in df.orderBy("session", "frame").collect():
        now = {"a"} if r["frame"] % 4 == 0 else {"a", r["zone"]}
        if r["session"] in was and now != was[r["session"]]:
            want.append((r["session"], r["frame"], "|".join(sorted(now - was[r["session"]])), "|".join(sorted(was[r["session"]] - now))))
        was[r["session"]] = now
    assert got == sorted(want)


def test_newest_and_dropped(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "box long, frame long, v string")
    assert sorted(map(tuple, rules.newest(df, "box", "frame").collect())) == [(1, 2, "b"), (2, 1, "c")]
    assert dict(map(tuple, rules.dropped(df, "box", "frame").collect())) == {1: 1, 2: 0}


def test_queues_of_a_stream(spark, tmp_path):
    """Each micro-batch delivers at most the queue's rows of a key, and the others are logged."""
    for k in range(2):
        spark.createDataFrame([(s, 10 * k + i, 0, "a", "n", 1.0) for s in (1, 2) for i in range(5 if s == 1 else 2)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for policy, want in (("drop_oldest", [3, 4, 13, 14]), ("drop_newest", [0, 1, 10, 11]), ("lossless", [0, 1, 2, 3, 4, 10, 11, 12, 13, 14])):
        out = str(tmp_path / policy)
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = src.writeStream.foreachBatch(lambda b, _, out=out, policy=policy: rules.delivered(b, out, "session", "frame", 2, policy)).option("checkpointLocation", out + "-ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.read.parquet(out + "/rows")
        assert sorted(r["frame"] for r in rows.where("session = 1").collect()) == want and rows.where("session = 2").count() == 4
        assert spark.read.parquet(out + "/drops").count() == 14 - rows.count()
