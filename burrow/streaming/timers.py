"""Streams that act on time and forget: alarms of silent sessions, ticks of running ones, counters of a run, frames closed by the next.

All need the state store of ``stateful.STORE``. Their batch twins are in ``burrow.operators.live`` and ``joins.folded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.streaming.stateful import Steps, stepped


class _Stalls(Steps):
    state, out = "last_us long, due_ms long, stalled boolean", "t_us long, event string"

    def __init__(self, stall_us: int, event: bool):
        self.stall_us, self.event = stall_us, event

    def row(self, state, now_ms, t_us, frame):
        told = []
        if state is not None:
            last, _, stalled = state
            if not stalled and self.event and t_us - last > self.stall_us:
                told.append((last + self.stall_us, "stalled"))
                stalled = True
            if stalled:
                told.append((t_us, "recovered"))
        # an alarm is due when more than the span has passed
        due = (t_us + self.stall_us) // 1000 + 1 if self.event else now_ms + self.stall_us // 1000
        return (t_us, due, False), told

    def wakes(self, state):
        return None if state is None or state[2] else state[1]

    def woken(self, state, now_ms):
        last, due, _ = state
        return (last, due, True), [(last + self.stall_us, "stalled")]


def stalls(df: DataFrame, stall_us: int, late: str | None = None) -> DataFrame:
    """session, t_us, event: "stalled" once when a session gives no row for longer than stall_us, "recovered" with its next row.

    On the processing clock, or on the rows' own if ``late`` gives a watermark; then other sessions' rows move the time on. No row of the session is needed.
    """
    return stepped(df, _Stalls(stall_us, late is not None), late=late, waits=False, timers=True)


class _Ticks(Steps):
    """Counters of a running session, told at each multiple of a period since its start."""

    def __init__(self, counters: dict[str, str], period_us: int, event: bool):
        self.prefixes, self.period, self.event = list(counters.values()), period_us, event
        self.reads = ["name", "mark"]
        self.state = "since_us long, ticks long, counts array<long>"
        self.out = ", ".join(["t_us long", *(f"{c} long" for c in counters)])

    def _told(self, state: tuple, until_us: int) -> tuple[tuple, list[tuple]]:
        """Ticks up to a time; what happens at a tick's time is after it."""
        since, ticks, counts = state
        told = []
        while since + (ticks + 1) * self.period <= until_us:
            ticks += 1
            told.append((since + ticks * self.period, *counts))
        return (since, ticks, counts), told

    def row(self, state, now_ms, t_us, frame, name, mark):
        clock = t_us if self.event else now_ms * 1000
        told = []
        if state is not None:
            state, told = self._told(state, clock)
        if mark == "start":
            state = (clock, 0, [0] * len(self.prefixes))
        elif mark == "stop":
            state = None
        elif state is not None and name is not None:
            state = (*state[:2], [n + name.startswith(p) for n, p in zip(state[2], self.prefixes)])
        return state, told

    def wakes(self, state):
        return None if state is None else (state[0] + (state[1] + 1) * self.period) // 1000 + 1

    def woken(self, state, now_ms):
        return self._told(state, now_ms * 1000)


def ticks(df: DataFrame, counters: dict[str, str], start: Column, stop: Column, period_us: int = 1_000_000, late: str | None = None) -> DataFrame:
    """session, t_us and each counter (label: prefix of the rows' name) at every period of a running session, from its start to its stop.

    Formulas over the counters are a projection of this (``operators.events.calculated``); they give 0 where they can't be computed, so no
    session can hold up another. On the processing clock, or on the rows' own if ``late`` gives a watermark.
    """
    mark = F.when(F.coalesce(start, F.lit(False)), "start").when(F.coalesce(stop, F.lit(False)), "stop")
    return stepped(df.withColumn("mark", mark), _Ticks(counters, period_us, late is not None), late=late, waits=False, timers=True)


class _Run(Steps):
    """Counts, open latencies and the sequence of the present run; a reset drops them all."""

    reads = ["name", "reset"]
    state, out = "run long, counts array<long>, opened array<long>, tokens long", "frame long, run long, kind string, label string, value long"

    def __init__(self, counters: dict[str, str], pairs: dict[str, tuple[str, str]], tokens: dict[str, str]):
        self.counters, self.pairs, self.tokens = counters, pairs, tokens

    def _fresh(self, run: int) -> tuple:
        return run, [0] * len(self.counters), [None] * len(self.pairs), 0

    def row(self, state, now_ms, t_us, frame, name, reset):
        run, counts, opened, tokens = state or self._fresh(0)
        if reset:
            run, counts, opened, tokens = self._fresh(run + 1)
        counts, opened, told = list(counts), list(opened), []
        if name is not None:
            for i, (label, prefix) in enumerate(self.counters.items()):
                if name.startswith(prefix):
                    counts[i] += 1
                    told.append((frame, run, "count", label, counts[i]))
            for i, (label, (first, last)) in enumerate(self.pairs.items()):
                if name.startswith(first):
                    opened[i] = t_us
                elif name.startswith(last) and opened[i] is not None:
                    told.append((frame, run, "latency", label, t_us - opened[i]))
                    opened[i] = None
            token = next((t for t, p in self.tokens.items() if name.startswith(p)), None)
            if token is not None:
                tokens += 1
                told.append((frame, run, "token", token, tokens))
        return (run, counts, opened, tokens), told


def run_messages(df: DataFrame, reset: Column, counters: dict[str, str], pairs: dict[str, tuple[str, str]], tokens: dict[str, str], late: str | None = None) -> DataFrame:
    """session, frame, run, kind, label, value: the streaming twin of ``operators.live.run_messages``."""
    return stepped(df.withColumn("reset", F.coalesce(reset, F.lit(False))), _Run(counters, pairs, tokens), late=late)


class _Folding(Steps):
    """The open frame and the notes since it opened."""

    reads = ["note"]
    state, out = "frame long, opened_us long, names string", "frame long, t_us long, names string"

    def __init__(self, close_us: int | None):
        self.close_us = close_us

    def order(self, row):
        return row[0], row[2] is not None, row[1]

    def row(self, state, now_ms, t_us, frame, note):
        open_frame, opened, names = state or (None, None, "")
        if note is not None:
            return (open_frame, opened, f"{names}|{note}" if names else note), ()
        if open_frame is None:  # notes before the first frame are its own
            return (frame, t_us, names), ()
        return (frame, t_us, ""), [(open_frame, opened, names)]

    def wakes(self, state):
        return None if state is None or state[0] is None or self.close_us is None else (state[1] + self.close_us) // 1000 + 1

    def woken(self, state, now_ms):
        return None, [state]


def folded(frames: DataFrame, notes: DataFrame, name: str, order: str, late: str, close_us: int | None = None) -> DataFrame:
    """session, frame, t_us, names: each frame with the notes since it opened, told when the next frame opens.

    The streaming twin of ``operators.joins.folded``: rows of both streams may come in any order within ``late``. A frame
    without a next one is told after close_us; what is noted later goes to the next frame.
    """
    f = frames.select("session", "t_us", F.col("frame").cast("long").alias("frame"), F.lit(None).cast("string").alias("note"))
    n = notes.select("session", "t_us", F.col(order).cast("long").alias("frame"), F.col(name).alias("note")).where("note IS NOT NULL")
    return stepped(f.unionByName(n), _Folding(close_us), late=late, timers=True)
