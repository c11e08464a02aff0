"""Registry of queries: a Spark function (spark, sf_dir) and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: session, frame (order), t_us, zone, speed, k, x and y."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("event_type").alias("zone"), F.col("value").alias("speed"), k.alias("k"), F.col("value").alias("x"), k.cast("double").alias("y"))


#: The twin of ``frames`` with dt_us, as a list of common table expressions.
FRAMES = """f AS (SELECT user_id AS session, event_id AS frame, epoch_us(ts) AS t_us, event_type AS zone, value AS speed,
  TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events),
d AS (SELECT *, coalesce(t_us - lag(t_us) OVER (PARTITION BY session ORDER BY frame), 0) AS dt_us,
  coalesce(sqrt(pow(speed - lag(speed) OVER (PARTITION BY session ORDER BY frame), 2) + pow(k - lag(k) OVER (PARTITION BY session ORDER BY frame), 2)), 0) AS step FROM f)"""

#: Runs of equal zones over ``d``, as further expressions: r (frames with run) and s (one row per run).
RUNS = """c AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN zone IS NOT DISTINCT FROM lag(zone) OVER w THEN 0 ELSE 1 END AS ch,
  sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el FROM d WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT session, run, zone, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, sum(dt_us) AS time_us, min(el - dt_us) AS start_us FROM r GROUP BY ALL)"""
