"""Sinks: cohort tables, a self-contained HTML report, append-only logs and drop logs."""

from __future__ import annotations

import html
import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.functions.scalars import escaped, format_elapsed

#: Rows that a report page may show; larger results belong in a table.
REPORT_ROWS = 10_000


def write_cohort(path: str, settings: dict, **tables: DataFrame) -> list[str]:
    """One folder of Parquet per table (session_summary, group_summary, transitions, time_bins, excluded), and the settings as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(posixpath.join(path, name))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(posixpath.join(path, "settings"))
    return sorted(tables)


def read_cohort_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(posixpath.join(path, n)) for n in names}


def published(df: DataFrame, path: str, keep: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The kept columns in order and under their new names, written as CSV with a header; missing columns are left out."""
    chosen = [c for c in (keep or df.columns) if c in df.columns]
    out = df.select(*(F.col(c).alias((names or {}).get(c, c)) for c in chosen))
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def report(title: str, **tables: DataFrame) -> str:
    """A page that holds its tables as JSON, NaN and infinities as null. Raises if a table is too long for a page."""
    parts = []
    for name, df in tables.items():
        clean = df.select(*(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
        rows = clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("j")).limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name} has more than {REPORT_ROWS} rows: write it as a table")
        data = "[" + ",".join(r["j"] for r in rows) + "]"
        parts.append(f'<h2>{html.escape(name)}</h2><script type="application/json" id="{html.escape(name)}">{data.replace("</", "<\\/")}</script>')
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{"".join(parts)}'


def log_lines(events: DataFrame) -> DataFrame:
    """value: one line per event (t_ms, type, subtype, content), tab-separated, seconds with three decimals, control characters escaped."""
    text = lambda c: F.coalesce(escaped(F.col(c).cast("string")), F.lit(""))
    return events.select(F.concat_ws("\t", F.format_string("%.3f", F.col("t_ms") / 1000.0), text("type"), text("subtype"), text("content")).alias("value"))


def frame_lines(frames: DataFrame) -> DataFrame:
    """value: one line per frame with the elapsed clock; an absent zone is ``na``."""
    return frames.select(F.concat_ws("\t", F.col("frame").cast("string"), format_elapsed(F.col("t_ms")), F.coalesce(F.col("zone"), F.lit("na"))).alias("value"))


def drop_counts(drops: DataFrame) -> DataFrame:
    """stream, reason, drops, first_frame, last_frame of a drop log; repeated frames count each."""
    return drops.groupBy("stream", "reason").agg(F.count("*").alias("drops"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def append_changes(changes: DataFrame, path: str) -> None:
    """Adds changes as JSON lines below path; what is there already stays as it is, so writers never rewrite one another's lines."""
    changes.write.mode("append").json(path)
