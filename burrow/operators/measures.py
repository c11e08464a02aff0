"""Measures of a series: time, distance, visits, still bouts and transitions, per session or any group.

Durations are sums of integer microseconds, divided once at the end. A frame's interval and step
belong to the frame they arrive at, so sums over any partition of the frames add up to the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.operators.series import FRAME, SESSION, along, elapsed, runs, spans

#: What counts as no zone in every transition count.
NO_ZONE = ("", "na", "none", "None", "-")


def seconds(us: Column | str) -> Column:
    return (F.col(us) if isinstance(us, str) else us) / 1e6


def totals(df: DataFrame, *keys: str, dt: str = "dt_us", step: str = "step", speed: str = "speed", where: Column | None = None) -> DataFrame:
    """duration_s, path, mean_rate (0 without time) and peak_rate (0 without frames) of the frames where a condition holds."""
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    time, path = F.sum(F.when(inside, F.col(dt)).otherwise(0)), F.sum(F.when(inside, F.col(step)).otherwise(0.0))
    return df.groupBy(*(keys or (SESSION,))).agg(
        seconds(time).alias("duration_s"),
        path.alias("path"),
        F.when(time > 0, path / seconds(time)).otherwise(0.0).alias("mean_rate"),
        F.coalesce(F.max(F.when(inside, F.col(speed))), F.lit(0.0)).alias("peak_rate"),
    )


def is_partial(covered_us: Column, width_us: Column) -> Column:
    """A bin of which less than 95 % was recorded."""
    return covered_us < 0.95 * width_us


def visits(df: DataFrame, inside: Column, least_us: int, variant: str = "a", dt: str = "dt_us") -> DataFrame:
    """Visits per session: entries, exits, latency_us (start of the first counted), total_us inside, visit_us of counted ones.

    A run inside counts once it has lasted least_us. The variants differ in when it may qualify:
    ``a`` on a frame after its first, with a tolerance of a nanosecond; ``b`` on any frame, exactly;
    ``c`` on a frame after its first, exactly. A visit still open at the end has no exit.
    """
    flagged = df.withColumn("inside", F.coalesce(inside, F.lit(False)))
    s = spans(flagged, "inside", dt)
    last = df.groupBy(SESSION).agg(F.max(FRAME).alias("end_frame"))
    long = F.col("time_us") >= (least_us - 0.001 if variant == "a" else least_us)
    counts = F.col("inside") & long & (F.lit(True) if variant == "b" else F.col("frames") >= 2)
    s = s.join(last, SESSION).withColumn("counts", counts)
    return s.groupBy(SESSION).agg(
        F.count(F.when(F.col("counts"), 1)).alias("entries"),
        F.count(F.when(F.col("counts") & (F.col("last_frame") < F.col("end_frame")), 1)).alias("exits"),
        F.min(F.when(F.col("counts"), F.col("start_us"))).alias("latency_us"),
        F.sum(F.when(F.col("inside"), F.col("time_us")).otherwise(0)).alias("total_us"),
        F.sum(F.when(F.col("counts"), F.col("time_us")).otherwise(0)).alias("visit_us"),
    )


def zone_visits(df: DataFrame, zone: str, least_us: int, dt: str = "dt_us") -> DataFrame:
    """Visits of every zone at once (variant a): session, zone, entries, latency_us, total_us, longest_us."""
    s = spans(df, zone, dt)
    counts = (F.col("time_us") >= least_us - 0.001) & (F.col("frames") >= 2)
    return s.groupBy(SESSION, zone).agg(
        F.count(F.when(counts, 1)).alias("entries"),
        F.min(F.when(counts, F.col("start_us"))).alias("latency_us"),
        F.sum("time_us").alias("total_us"),
        F.max(F.when(counts, F.col("time_us"))).alias("longest_us"),
    )


def still_bouts(df: DataFrame, speed: str, below: float, least_us: int, dt: str = "dt_us") -> DataFrame:
    """Runs slower than ``below`` that last least_us: still_us, bouts, latency_us per session."""
    s = spans(df.withColumn("still", F.coalesce(F.col(speed) < below, F.lit(False))), "still", dt)
    counts = F.col("still") & (F.col("time_us") >= least_us - 0.001)
    return s.groupBy(SESSION).agg(
        F.sum(F.when(counts, F.col("time_us")).otherwise(0)).alias("still_us"),
        F.count(F.when(counts, 1)).alias("bouts"),
        F.min(F.when(counts, F.col("start_us"))).alias("latency_us"),
    )


def _zoned(df: DataFrame, zone: str) -> DataFrame:
    return df.where(F.col(zone).isNotNull() & ~F.col(zone).isin(*NO_ZONE))


def transition_matrix(df: DataFrame, zone: str, *stage: str) -> DataFrame:
    """session, [stage], from_zone, to_zone, n: ordered moves between different zones, frames without a zone skipped.

    With a stage column, a move counts only inside one run of equal stages.
    """
    base = runs(df, stage[0], "stage_run") if stage else df.withColumn("stage_run", F.lit(0))
    moves = _zoned(base, zone).withColumn("from_zone", F.lag(zone).over(along("stage_run")))
    moved = moves.where(F.col("from_zone") != F.col(zone))
    return moved.groupBy(SESSION, *stage, "from_zone", F.col(zone).alias("to_zone")).agg(F.count("*").alias("n"))


def transitions_total(df: DataFrame, zone: str, only: tuple[str, ...] = ()) -> DataFrame:
    """session, transitions: moves to a different zone, counting only the zones in ``only`` if given; 0 for sessions without any."""
    zoned = _zoned(df, zone)
    if only:
        zoned = zoned.where(F.col(zone).isin(*only))
    moves = zoned.withColumn("before", F.lag(zone).over(along())).groupBy(SESSION).agg(F.count(F.when(F.col("before") != F.col(zone), 1)).alias("transitions"))
    return df.select(SESSION).distinct().join(moves, SESSION, "left").fillna(0, ["transitions"])


def alternation(df: DataFrame, zone: str) -> DataFrame:
    """session, triads, alternations, alternation_pct: share of three successive visits that are to three different zones."""
    seq = _zoned(runs(_zoned(df, zone), zone, "visit"), zone).groupBy(SESSION, "visit", zone).agg(F.min(FRAME).alias(FRAME))
    w = along()
    t = seq.withColumns({"one": F.lag(zone, 1).over(w), "two": F.lag(zone, 2).over(w)}).where("two IS NOT NULL")
    distinct = (F.col(zone) != F.col("one")) & (F.col("one") != F.col("two")) & (F.col(zone) != F.col("two"))
    return t.groupBy(SESSION).agg(F.count("*").alias("triads"), F.count(F.when(distinct, 1)).alias("alternations")).withColumn("alternation_pct", 100.0 * F.col("alternations") / F.col("triads"))


def preference(df: DataFrame, zone: str, novel: str, familiar: str, dt: str = "dt_us") -> DataFrame:
    """session, novel_us, familiar_us, index (novel - familiar over both) and percent (novel of both); null without time in either."""
    time = lambda z: F.sum(F.when(F.col(zone) == z, F.col(dt)).otherwise(0))
    out = df.groupBy(SESSION).agg(time(novel).alias("novel_us"), time(familiar).alias("familiar_us"))
    both = F.col("novel_us") + F.col("familiar_us")
    return out.withColumns({"preference": F.when(both > 0, (F.col("novel_us") - F.col("familiar_us")) / both), "percent": F.when(both > 0, 100.0 * F.col("novel_us") / both)})


def discrimination(times: DataFrame, name: str = "name", us: str = "us") -> DataFrame:
    """session, total_us, index, percent of sessions with exactly two objects: later minus earlier of their times (by name) over both, and the later one's share.

    times has session, name and us, one row per object; none for sessions without time at either.
    """
    pair = times.groupBy(SESSION).agg(F.array_sort(F.collect_list(F.struct(name, us))).alias("p"))  # a session's objects, a handful
    a, b = F.col("p")[0][us], F.col("p")[1][us]
    d = pair.where(F.size("p") == 2).withColumn("total_us", a + b).where("total_us > 0")
    return d.select(SESSION, "total_us", F.round((b - a) / F.col("total_us"), 4).alias("index"), F.round(100 * b / F.col("total_us"), 2).alias("percent"))


def cumulative(df: DataFrame, step: str = "step") -> DataFrame:
    """Adds the distance walked so far."""
    return elapsed(df, step, "distance")


def state_rows(df: DataFrame, state: str, dt: str = "dt_us", step: str = "step") -> DataFrame:
    """One row per state of a session, all its frames together, in order of first appearance; intervals stay those of the session."""
    return df.where(F.col(state).isNotNull()).groupBy(SESSION, state).agg(F.count("*").alias("frames"), seconds(F.sum(dt)).alias("duration_s"), F.sum(step).alias("path"), F.min(FRAME).alias("first_frame"))


def span_rows(df: DataFrame, state: str, clock: str = "t_us", least_frames: int = 2) -> DataFrame:
    """One row per run of a state; the first interval of a run doesn't count, as if the run were cut out first. Shorter runs are left out."""
    r = runs(df, state, "run")
    return r.groupBy(SESSION, "run", state).agg(F.count("*").alias("frames"), seconds(F.max(clock) - F.min(clock)).alias("duration_s"), F.min(FRAME).alias("first_frame")).where(F.col("frames") >= least_frames)


def interleaved(df: DataFrame, state: str) -> DataFrame:
    """session, spans, names, interleaved: at least three spans per distinct name, so grouping by name is the better row shape."""
    s = spans(df.withColumn("zero", F.lit(0)), state, "zero").where(F.col(state).isNotNull() & (F.col(state) != ""))
    return s.groupBy(SESSION).agg(F.count("*").alias("spans"), F.count_distinct(state).alias("names")).withColumn("interleaved", F.col("spans") >= 3 * F.col("names"))


def regions(df: DataFrame, zone: str, members: dict[str, list[str]], dt: str = "dt_us") -> DataFrame:
    """session, region, total_us: a frame in any member zone is in the region once."""
    inside = [F.sum(F.when(F.col(zone).isin(*zones), F.col(dt)).otherwise(0)).alias(name) for name, zones in members.items()]
    wide = df.groupBy(SESSION).agg(*inside)
    return wide.unpivot([SESSION], list(members), "region", "total_us")
