"""Ordered series per session: intervals, steps, runs and what is carried forward.

A series is a DataFrame with the columns ``session`` and ``frame`` (its order). Every function
uses the same window, partitioned by session and ordered by frame, so a plan that chains
several of them has one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION, FRAME = "session", "frame"


def along(*more: str):
    """The window of one session (and of each value of ``more``) in frame order."""
    return Window.partitionBy(SESSION, *more).orderBy(FRAME)


def onward(*more: str):
    """The same rows from the end, for what comes next: a frame that reaches from a row to the end is computed anew for each row, with the square of their number."""
    return Window.partitionBy(SESSION, *more).orderBy(F.desc(FRAME))


def intervals(df: DataFrame, clock: str = "t_us", out: str = "dt_us") -> DataFrame:
    """Time since the previous frame; 0 on a session's first frame. Belongs to the arriving frame."""
    return df.withColumn(out, F.coalesce(F.col(clock) - F.lag(clock).over(along()), F.lit(0)))


def reset_safe_intervals(df: DataFrame, clock: str = "t_us", out: str = "dt_us", fallback: int = 33_000) -> DataFrame:
    """Like ``intervals`` where the clock may jump back: such an interval is the session's median positive one, ``fallback`` if there is none."""
    raw = df.withColumn("raw_dt", F.col(clock) - F.lag(clock).over(along()))
    median = F.percentile(F.when(F.col("raw_dt") > 0, F.col("raw_dt")), 0.5).over(Window.partitionBy(SESSION))
    safe = F.when(F.col("raw_dt") < 0, F.coalesce(median, F.lit(float(fallback)))).otherwise(F.coalesce(F.col("raw_dt"), F.lit(0)))
    return raw.withColumn(out, safe.cast("double")).drop("raw_dt")


def steps(df: DataFrame, x: str = "x", y: str = "y", dt: str = "dt_us", min_move: float = 0.0) -> DataFrame:
    """step (0 across gaps and below min_move) and speed per second (0 where no time passed)."""
    far = F.sqrt(F.pow(F.col(x) - F.lag(x).over(along()), 2) + F.pow(F.col(y) - F.lag(y).over(along()), 2))
    out = df.withColumn("step", F.coalesce(F.when(far >= min_move, far), F.lit(0.0)))
    return out.withColumn("speed", F.when(F.col(dt) > 0, F.col("step") * 1e6 / F.col(dt)).otherwise(0.0))


def runs(df: DataFrame, value: Column | str, out: str = "run", *keys: str) -> DataFrame:
    """Numbers each run of equal values along a session (nulls are equal to each other)."""
    value = F.col(value) if isinstance(value, str) else value
    w = along(*keys)
    marked = df.withColumn("run_value", value)
    starts = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col("run_value").eqNullSafe(F.lag("run_value").over(w))).cast("int"))
    return marked.withColumn("run_start", starts).withColumn(out, F.sum("run_start").over(w)).drop("run_start", "run_value")


def elapsed(df: DataFrame, dt: str = "dt_us", out: str = "elapsed_us") -> DataFrame:
    """Time from the session's start to the frame, both ends' intervals as they are: the running sum of dt."""
    return df.withColumn(out, F.sum(dt).over(along().rowsBetween(Window.unboundedPreceding, 0)))


def spans(df: DataFrame, value: str, dt: str = "dt_us", *keep: str) -> DataFrame:
    """One row per run of equal values: session, run, value, first and last frame, n frames, time, and start before its first interval."""
    e = elapsed(df, dt, "span_elapsed")
    r = runs(e, value, "run")
    return r.groupBy(SESSION, "run", value, *keep).agg(
        F.min(FRAME).alias("first_frame"),
        F.max(FRAME).alias("last_frame"),
        F.count("*").alias("frames"),
        F.sum(dt).alias("time_us"),
        F.min(F.col("span_elapsed") - F.col(dt)).alias("start_us"),
    )


def carried(df: DataFrame, value: str, out: str) -> DataFrame:
    """The last non-null value at or before each frame."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0)))


def rising(df: DataFrame, active: Column, out: str = "fired") -> DataFrame:
    """True on frames where a condition turns true; a session's first frame fires if it is true."""
    return df.withColumn("now_active", F.coalesce(active, F.lit(False))).withColumn(out, F.col("now_active") & ~F.coalesce(F.lag("now_active").over(along()), F.lit(False))).drop("now_active")


def held(df: DataFrame, condition: Column, least_us: int, dt: str = "dt_us", out: str = "held") -> DataFrame:
    """The part of each true run after it has lasted least_us."""
    marked = runs(df.withColumn("held_now", F.coalesce(condition, F.lit(False))), "held_now", "held_run")
    w = along("held_run").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.col("held_now") & (F.sum(dt).over(w) >= least_us)).drop("held_now", "held_run")


def row_speed(df: DataFrame, x: str = "x", y: str = "y", clock: str = "t_us", scale: float = 1.0, out: str = "row_speed") -> DataFrame:
    """Distance from the previous row over scale, per second; 0 on a session's first row, where no time passed, and next to an absent position."""
    w = along()
    far = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / scale
    dt = (F.col(clock) - F.lag(clock).over(w)) / 1e6
    return df.withColumn(out, F.coalesce(F.when(dt > 0, far / dt), F.lit(0.0)))
