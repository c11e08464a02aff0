"""What a running rig computes from each row, in batch form.

``burrow.streaming.timers`` has the streams that give the rows of ``stall_edges``, ``ticks`` and ``run_messages``; coordinates, forecasts and
chunks are the same expressions on a stream's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.scan import ordered_scan
from burrow.operators.series import SESSION, along

LOST = -1.0


def coordinate(name: str, speed: Column, x: Column, y: Column, zone: Column) -> Column:
    """What a named coordinate sends, as text: the speed, a part's x or y (-1.0 when it is lost), else the zone it is in."""
    low = name.lower()
    if name == "speed":
        return speed.cast("string")
    if low == "x" or low.endswith("_x"):
        return F.coalesce(x, F.lit(LOST)).cast("string")
    if low == "y" or low.endswith("_y"):
        return F.coalesce(y, F.lit(LOST)).cast("string")
    return F.coalesce(zone, F.lit(""))


def horizon_ms(fps: Column, measured: Column, most: float = 75.0) -> Column:
    """How far ahead to forecast: the measured delay, else a frame up to 30 fps and two beyond, 33 ms without a rate; never more than ``most``."""
    frame = 1000.0 / fps
    return F.least(F.coalesce(measured, F.when(fps > 30, 2 * frame).when(fps > 0, frame).otherwise(33.0)), F.lit(most))


def ahead(x: Column, vx: Column, ms: Column, lost: Column) -> Column:
    """Where a point will be after ms at its velocity per second; null while it is lost, so that the caller keeps what it has."""
    return F.when(~lost, x + vx * ms / 1000.0)


def since_reset(df: DataFrame, reset: Column, name: str = "zone") -> DataFrame:
    """df with run (how many resets there were) and n, the running count of the name since the last reset; a reset row starts anew and counts."""
    d = df.withColumn("run", F.sum(F.coalesce(reset.cast("int"), F.lit(0))).over(along()))
    return d.withColumn("n", F.count("*").over(Window.partitionBy(SESSION, "run", name).orderBy("frame")))


def set_changes(df: DataFrame, zones: str) -> DataFrame:
    """session, frame, entered, gone (bar-joined, sorted): differences of a frame's array of zones from the one before; a session's first is only the baseline."""
    now = F.array_sort(F.array_distinct(F.col(zones)))
    d = df.select(SESSION, "frame", now.alias("now")).withColumn("was", F.lag("now").over(along())).where("was IS NOT NULL AND was <> now")
    names = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), "|")
    return d.select(SESSION, "frame", names("now", "was").alias("entered"), names("was", "now").alias("gone"))


def watchdog(df: DataFrame, stall_us: int, least_rate: float, clock: str = "t_us") -> DataFrame:
    """session, stalls (gaps longer than stall_us), longest_us, per_second, low: whether fewer rows a second came than least_rate times 0.8."""
    gap = F.col(clock) - F.lag(clock).over(along())
    d = df.withColumn("gap", gap).groupBy(SESSION).agg(F.count_if(F.col("gap") > stall_us).alias("stalls"), F.max("gap").alias("longest_us"), (F.count("*") - 1).alias("steps"), ((F.max(clock) - F.min(clock)) / 1e6).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("steps") / F.col("seconds"))
    return d.select(SESSION, "stalls", "longest_us", rate.alias("per_second"), F.coalesce(rate < 0.8 * least_rate, F.lit(False)).alias("low"))


def stall_edges(df: DataFrame, stall_us: int, until_us: int) -> DataFrame:
    """session, t_us, event: "stalled" where a session gave no row for longer than stall_us (at last + stall_us), "recovered" with its next row.

    until_us: the time now; a session whose last row is longer ago is stalled.
    """
    d = df.withColumn("before", F.lag("t_us").over(along())).withColumn("after", F.lead("t_us").over(along()))
    stalled = F.coalesce("after", F.lit(until_us)) - F.col("t_us") > stall_us
    recovered = F.col("t_us") - F.col("before") > stall_us
    events = F.array_compact(F.array(F.when(stalled, F.struct((F.col("t_us") + stall_us).alias("t_us"), F.lit("stalled").alias("event"))), F.when(recovered, F.struct("t_us", F.lit("recovered").alias("event")))))
    return d.select(SESSION, F.explode(events).alias("e")).select(SESSION, "e.t_us", "e.event")


def ticks(df: DataFrame, counters: dict[str, str], start: Column, stop: Column, period_us: int, name: str = "name") -> DataFrame:
    """session, t_us and each counter (label: prefix of names) at every period of a run: from its start to its stop, the next start or the session's last row.

    Counted is what came after the start and before the tick.
    """
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    d = df.select(SESSION, "frame", "t_us", F.col(name).alias("name"), flag(start).alias("start"), flag(stop).alias("stop"))
    d = d.withColumn("run", F.sum("start").over(along())).where("run > 0")
    d = d.withColumn("stops", F.sum("stop").over(along("run"))).withColumn("last_us", F.max("t_us").over(Window.partitionBy(SESSION)))
    runs = d.groupBy(SESSION, "run", "last_us").agg(F.min(F.when(F.col("start") == 1, F.col("t_us"))).alias("since"), F.min(F.when(F.col("stop") == 1, F.col("t_us"))).alias("stopped"))
    runs = runs.withColumn("until", F.coalesce("stopped", F.lead("since").over(Window.partitionBy(SESSION).orderBy("run")), "last_us"))
    n = F.floor((F.col("until") - F.col("since")) / period_us).cast("long")
    at = runs.where(n > 0).select(SESSION, "run", "since", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
    at = at.select(SESSION, "run", (F.col("since") + F.col("i") * period_us).alias("t_us"), F.lit(0).alias("is_row"), *(F.lit(0).alias(c) for c in counters))
    told = d.where("start = 0 AND stops = 0").select(SESSION, "run", "t_us", F.lit(1).alias("is_row"), *(flag(F.startswith("name", F.lit(p))).alias(c) for c, p in counters.items()))
    w = Window.partitionBy(SESSION, "run").orderBy("t_us", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    both = at.unionByName(told)
    return both.withColumns({c: F.sum(c).over(w) for c in counters}).where("is_row = 0").select(SESSION, "t_us", *counters)


def run_messages(df: DataFrame, reset: Column, counters: dict[str, str], pairs: dict[str, tuple[str, str]], tokens: dict[str, str], name: str = "name") -> DataFrame:
    """session, frame, run, kind, label, value of what each row changes; a reset row starts a new run and drops counts, open latencies and the sequence.

    counters (label: prefix of names): running counts; pairs (label: first and last prefix): microseconds from the latest first row to the last one;
    tokens (token: prefix, the first that fits): their number in the run's sequence.
    """
    d = df.withColumn("run", F.sum(F.coalesce(reset.cast("int"), F.lit(0))).over(along()).cast("long"))
    starts = lambda p: F.coalesce(F.startswith(name, F.lit(p)), F.lit(False))
    in_run = along("run")
    told = []
    for label, p in counters.items():
        told.append(F.when(starts(p), F.struct(F.lit("count").alias("kind"), F.lit(label).alias("label"), F.count_if(starts(p)).over(in_run).alias("value"))))
    for label, (first, last) in pairs.items():
        mark = F.when(starts(first), F.struct(F.lit(True).alias("first"), F.col("t_us").alias("t"))).when(starts(last), F.struct(F.lit(False).alias("first"), F.col("t_us").alias("t")))
        before = F.last(mark, ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
        told.append(F.when(starts(last) & ~starts(first) & before["first"], F.struct(F.lit("latency").alias("kind"), F.lit(label).alias("label"), (F.col("t_us") - before["t"]).alias("value"))))
    token = F.coalesce(*(F.when(starts(p), F.lit(t)) for t, p in tokens.items()), F.lit(None).cast("string"))
    told.append(F.when(token.isNotNull(), F.struct(F.lit("token").alias("kind"), token.alias("label"), F.count(token).over(in_run).alias("value"))))
    d = d.select(SESSION, "frame", "run", F.array(*told).alias("told"))  # windows first, then rows of them
    return d.select(SESSION, "frame", "run", F.explode(F.array_compact("told")).alias("m")).select(SESSION, "frame", "run", "m.*")


def chunk_times(chunks: DataFrame, rate: float, snap_s: float = 0.001) -> DataFrame:
    """session, chunk, i, t_s, value of sampled chunks (session, chunk, start_ms, values): samples 1/rate apart from the chunk's start.

    A start within snap_s of where the chunk before was taken to end is that end, so joined chunks have no seams; the first is compared with 0.
    """

    def begin():
        end = 0.0

        def step(starts: list, sizes: list) -> tuple[list]:
            nonlocal end
            seated = []
            for ms, n in zip(starts, sizes):
                start = end if abs(end - ms / 1000.0) < snap_s else ms / 1000.0
                end = start + n / rate
                seated.append(start)
            return (seated,)

        return step

    d = ordered_scan(chunks.withColumn("chunk_n", F.size("values")), begin, ["start_ms", "chunk_n"], "start_s double", order="chunk")
    e = d.select(SESSION, "chunk", "start_s", F.posexplode("values").alias("i", "value"))
    return e.select(SESSION, "chunk", "i", (F.col("start_s") + F.col("i") / rate).alias("t_s"), "value")
