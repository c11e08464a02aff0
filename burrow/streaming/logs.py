"""Live logs: frame rows closed by the next frame with a clock that doesn't run back, event and drop logs, all written as streams.

The frame log's rows are made on the state store (``frame_rows``), so a restarted query goes on where it was; its totals are an aggregate of what was written.
Batch twins: ``operators.joins.folded`` for the names, ``operators.clean.forward_clock`` for the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from burrow.sources.reports import log_lines
from burrow.streaming.stateful import Steps, stepped

#: Fixed value: a board clock that steps back by no more than so many ms holds its last value.
MOST_BACK_MS = 250.0


class _Rows(Steps):
    """The open frame with its clock and the names since it opened; the last clock told."""

    reads = ["note", "fw_ms", "has_pose"]
    state = "frame long, opened_us long, fw_ms double, clamped boolean, reseated boolean, has_pose boolean, last_ms double, names string"
    out = "frame long, t_us long, fw_ms double, clamped boolean, reseated boolean, has_pose boolean, names string"

    def __init__(self, close_us: int | None):
        self.close_us = close_us

    def order(self, row):
        return row[0], row[2] is not None, row[1]

    def row(self, state, now_ms, t_us, frame, note, fw_ms, has_pose):
        held = state or (None, None, None, False, False, False, None, "")
        *row, last, names = held
        if note is not None:
            return (*row, last, f"{names}|{note}" if names else note), ()
        back = last - fw_ms if None not in (last, fw_ms) else 0.0
        clamped, reseated = 0 < back <= MOST_BACK_MS, back > MOST_BACK_MS
        fw_ms = last if clamped else fw_ms
        opened = (frame, t_us, fw_ms, clamped, reseated, bool(has_pose), last if fw_ms is None else fw_ms)
        if row[0] is None:  # notes before the first frame are its own
            return (*opened, names), ()
        return (*opened, ""), [(*row, names)]

    def wakes(self, state):
        return None if state is None or state[0] is None or self.close_us is None else (state[1] + self.close_us) // 1000 + 1

    def woken(self, state, now_ms):
        *row, last, names = state
        return (None, None, None, False, False, False, last, ""), [(*row, names)]


def frame_rows(frames: DataFrame, notes: DataFrame, name: str, order: str, late: str, close_us: int | None = None) -> DataFrame:
    """session, frame, t_us, fw_ms, clamped, reseated, has_pose, names: each frame when the next one opens, or after close_us.

    frames has session, frame, t_us, fw_ms (the board's clock, or null) and has_pose; notes has session, t_us, a name and their order. A clock that
    steps back by at most 250 ms holds its last value (clamped), one that steps back further starts anew (reseated).
    """
    f = frames.select("session", "t_us", F.col("frame").cast("long").alias("frame"), F.lit(None).cast("string").alias("note"), F.col("fw_ms").cast("double").alias("fw_ms"), F.coalesce("has_pose", F.lit(False)).alias("has_pose"))
    n = notes.select("session", "t_us", F.col(order).cast("long").alias("frame"), F.col(name).alias("note"), F.lit(None).cast("double").alias("fw_ms"), F.lit(False).alias("has_pose")).where("note IS NOT NULL")
    return stepped(f.unionByName(n), _Rows(close_us), late=late, timers=True)


def write_rows(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that appends rows to a table below path, a folder a session."""
    return rows.writeStream.format("parquet").partitionBy("session").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()


def write_events(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that appends event rows (t_ms, type, subtype, content) as lines of four cells."""
    return log_lines(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()


def totals(rows: DataFrame, drops: DataFrame | None = None, trackers: DataFrame | None = None) -> DataFrame:
    """session, frames, posed, timed, clamps, reseats, dropped, warnings: what a session's frame log holds.

    drops has a row (session) per lost frame; trackers (session, tracker) says which tracker a session declares. Warnings: no_pose, if it declares one
    and no frame has a pose; no_time, if no frame has a board time.
    """
    out = rows.groupBy("session").agg(F.count("*").alias("frames"), F.count_if("has_pose").alias("posed"), F.count("fw_ms").alias("timed"), F.count_if("clamped").alias("clamps"), F.count_if("reseated").alias("reseats"))
    lost = F.lit(0).cast("long")
    if drops is not None:
        out = out.join(drops.groupBy("session").agg(F.count("*").alias("lost")), "session", "left")
        lost = F.coalesce("lost", lost)
    declared = F.lit(False)
    if trackers is not None:
        out = out.join(trackers.select("session", "tracker"), "session", "left")
        declared = F.coalesce(~F.lower("tracker").isin("", "none", "unknown"), F.lit(False))
    warnings = F.array_compact(F.array(F.when(declared & (F.col("posed") == 0), F.lit("no_pose")), F.when(F.col("timed") == 0, F.lit("no_time"))))
    return out.select("session", "frames", "posed", "timed", "clamps", "reseats", lost.alias("dropped"), warnings.alias("warnings"))
