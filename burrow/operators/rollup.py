"""Roll-ups over sessions, boxes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_summary(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, measure, rows, n, mean, sd, sem: sample deviation, and its error over the root of the non-null count. Blank keys are left out, null ones kept."""
    long = rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in measures], "measure", "value")
    for k in keys:
        long = long.where(F.col(k).isNull() | (F.trim(F.col(k).cast("string")) != ""))
    out = long.groupBy(*keys, "measure").agg(F.count("*").alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return out.withColumn("sem", F.when(F.col("n") > 0, F.col("sd") / F.sqrt("n")))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("rank") <= n).drop("rank")


def latency_summary(samples: DataFrame, key: str, value: str, order: str, n: int = 240, most_ms: float = 10_000) -> DataFrame:
    """key, count, mean, p50, p95, p99 of the last n sane samples (not null, not negative, at most most_ms)."""
    sane = samples.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) <= most_ms))
    return last_n(sane, key, order, n).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)))


def deadline_misses(samples: DataFrame, key: str, value: str, budget: float) -> DataFrame:
    late = F.col(value) > budget
    return samples.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.when(late, 1)).alias("missed"), (F.count(F.when(late, 1)) / F.count("*")).alias("missed_share"), F.max(F.when(late, F.col(value) - budget)).alias("worst_over"))


def clock_stats(df: DataFrame, clock_ms: str) -> DataFrame:
    """session, median_ms, fps, variable, backward: rate of a clock from its positive steps; variable if their deviation is over 5 % of the median."""
    w = Window.partitionBy("session").orderBy("frame")
    d = df.withColumn("d", F.col(clock_ms) - F.lag(clock_ms).over(w))
    pos = F.when(F.col("d") > 0, F.col("d"))
    out = d.groupBy("session").agg(F.percentile(pos, 0.5).alias("median_ms"), F.stddev_pop(pos).alias("sd_ms"), F.count(F.when(F.col("d") < 0, 1)).alias("backward"))
    return out.select("session", "median_ms", F.when(F.col("median_ms") > 0, 1000.0 / F.col("median_ms")).alias("fps"), (F.col("sd_ms") > 0.05 * F.col("median_ms")).alias("variable"), "backward")


def top_n(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most common values; ties by name."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)
