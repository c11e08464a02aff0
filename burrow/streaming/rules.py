"""Streams of frames and log rows: per-key rules, latencies and sequences with state.

Each function takes a streaming (or batch) DataFrame with session, t_us and the columns its
rule needs, and keeps one small state per session, in the state store. Rows of a key are put in the order of
their clock inside a micro-batch; a row older than what an earlier one has seen is late and isn't used, as what it would have changed has
been sent. State stays for as long as the query runs: a few numbers a session. Every function has a batch twin among the operators, and tests hold the two equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_KEY = "session long"


def _stateful(df: DataFrame, columns: list[str], out: str, state: str, initial: tuple, step: Callable) -> DataFrame:
    """Runs step(row, state list) -> rows over each session's rows in clock order; state survives between micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *s, clock = held.get if held.exists else (*initial, -(1 << 62))
        rows = pd.concat(list(batches)).sort_values(["t_us", "frame"], kind="stable")
        rows = rows[rows["t_us"] >= clock]
        made = [(key[0], *r) for row in rows[["frame", "t_us", *columns]].itertuples(index=False) for r in step(row, s)]
        held.update((*s, int(rows["t_us"].max()) if len(rows) else clock))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in f"{_KEY}, {out}".split(", ")])

    return df.groupBy("session").applyInPandasWithState(run, f"{_KEY}, {out}", f"{state}, seen_us long", "append", GroupStateTimeout.NoTimeout)


def edges(df: DataFrame, active: Column, hold_us: int = 0) -> DataFrame:
    """session, frame, t_us of each frame where a condition, having held for hold_us, turns true."""

    def step(row, s):
        frame, t, on = row
        if not on:
            s[0], s[1] = -1, False
            return []
        if s[0] < 0:
            s[0] = t
        now = t - s[0] >= hold_us
        fired = now and not s[1]
        s[1] = bool(now)
        return [(frame, t)] if fired else []

    flagged = df.select("session", "frame", "t_us", F.coalesce(active, F.lit(False)).alias("on"))
    return _stateful(flagged, ["on"], "frame long, t_us long", "since long, was boolean", (-1, False), step)


def latencies(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """session, frame, latency_us: the streaming twin of ``operators.events.latencies``."""

    def step(row, s):
        frame, t, mark = row
        if mark == 1:
            s[0] = t
        elif mark == 2 and s[0] >= 0:
            since, s[0] = s[0], -1
            return [(frame, t - since)]
        return []

    mark = F.when(F.coalesce(start, F.lit(False)), 1).when(F.coalesce(end, F.lit(False)), 2).otherwise(0)
    return _stateful(df.select("session", "frame", "t_us", mark.alias("mark")), ["mark"], "frame long, latency_us long", "open long", (-1,), step)


def changes(df: DataFrame, value: str) -> DataFrame:
    """session, frame, value whenever it differs from the last sent; a session's first row is sent."""

    def step(row, s):
        frame, _, v = row
        if s[1] and s[0] == v:
            return []
        s[0], s[1] = v, True
        return [(frame, v)]

    return _stateful(df.select("session", "frame", "t_us", F.col(value).cast("string").alias("v")), ["v"], f"frame long, {value} string", "last string, seen boolean", ("", False), step)


def zone_changes(df: DataFrame, zones: str) -> DataFrame:
    """session, frame, entered, left: differences of a frame's set of zones (bar-joined) from the set before; the first set is only the baseline."""

    def step(row, s):
        frame, _, v = row
        now = {z for z in (v or "").split("|") if z}
        was = {z for z in s[0].split("|") if z}
        first = not s[1]
        s[0], s[1] = "|".join(sorted(now)), True
        if first or now == was:
            return []
        return [(frame, "|".join(sorted(now - was)), "|".join(sorted(was - now)))]

    return _stateful(df.select("session", "frame", "t_us", F.col(zones).alias("v")), ["v"], "frame long, entered string, gone string", "last string, seen boolean", ("", False), step)


def alternating(df: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """session, frame, n, token: ordered tokens of rows whose name starts with a prefix, numbered along the session."""

    def step(row, s):
        frame, _, token = row
        if token is None:
            return []
        s[0] += 1
        return [(frame, s[0], token)]

    token = F.coalesce(*(F.when(F.startswith("name", F.lit(p)), F.lit(t)) for t, p in tokens.items() if p))
    return _stateful(df.select("session", "frame", "t_us", token.alias("token")).where("token IS NOT NULL"), ["token"], "frame long, n long, token string", "n long", (0,), step)


def counts(df: DataFrame, name: str) -> DataFrame:
    """session, name, n: running counts, for output mode update or complete."""
    return df.groupBy("session", name).agg(F.count("*").alias("n"))


def windowed(df: DataFrame, ts: str, width: str, late: str, value: str) -> DataFrame:
    """start, name counts and mean of a value by tumbling window of event time; rows later than ``late`` are dropped by the watermark."""
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width), "zone")
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "zone", "n", "mean")


def newest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the newest row of a micro-batch; what a bounded queue that drops its oldest rows would deliver."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")


def dropped(batch: DataFrame, key: str, order: str) -> DataFrame:
    """key, dropped: how many rows ``newest`` leaves out."""
    return batch.groupBy(key).agg((F.count(order) - 1).alias("dropped"))


POLICIES = ("lossless", "drop_oldest", "drop_newest")


def queued(batch: DataFrame, key: str, order: str, depth: int, policy: str = "drop_oldest") -> DataFrame:
    """A micro-batch with kept: whether a queue of ``depth`` rows a key delivers a row. lossless keeps all, drop_oldest the last rows, drop_newest the first ones.

    What isn't kept is the drop log; keys don't touch one another.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    if policy == "lossless":
        return batch.withColumn("kept", F.lit(True))
    by = F.desc(order) if policy == "drop_oldest" else F.asc(order)
    return batch.withColumn("kept", F.row_number().over(Window.partitionBy(key).orderBy(by)) <= depth)


def delivered(batch: DataFrame, path: str, key: str, order: str, depth: int, policy: str = "drop_oldest") -> None:
    """For ``foreachBatch``: appends a micro-batch's kept rows to the table rows below path, and the key, place and policy of the others to drops."""
    q = queued(batch, key, order, depth, policy).persist()
    try:
        q.where("kept").drop("kept").write.mode("append").parquet(f"{path}/rows")
        q.where("NOT kept").select(F.col(key).alias("stream"), F.col(order).cast("long").alias("frame_idx"), F.lit(policy).alias("reason")).write.mode("append").parquet(f"{path}/drops")
    finally:
        q.unpersist()
