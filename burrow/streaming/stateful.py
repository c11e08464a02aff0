"""One way to keep state by key in a stream: steps over rows in the order of their clock, with timers.

``stepped`` runs a ``Steps`` object over each key's rows. State is one tuple in the state store, whatever the key has seen;
``transformWithState`` holds it, so a query restarts from its checkpoint and a lost executor's keys move on elsewhere. Rows come in
micro-batches, in any order. Without ``waits`` they are put in order within their micro-batch, and a row older than what the key has
seen is left out, for what it would have changed has been told. With ``waits`` rows stay in the store until the watermark has passed
them, so all that are late by less than its span are handled in order, as a batch over the same rows would. Timers run on the watermark where there is
one, else on the processing clock. Needs the RocksDB state store (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs for these streams.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Steps:
    """What a stream does with the rows of a key. Subclasses say what is read, kept and told; the last column of ``state`` is never null."""

    reads: list[str] = []
    state: str = ""
    out: str = ""

    def row(self, state: tuple | None, now_ms: int, t_us: int, frame: int, *values) -> tuple[tuple | None, Iterable[tuple]]:
        """The next state (None: there is none) and rows to tell, of out's columns. now_ms: on the clock of the timers."""
        raise NotImplementedError

    def order(self, row: tuple) -> tuple:
        """What rows (t_us, frame, values) of one key are sorted by; first the clock."""
        return row[:2]

    def wakes(self, state: tuple | None) -> int | None:
        """When (ms) ``woken`` is due if nothing else happens."""
        return None

    def woken(self, state: tuple | None, now_ms: int) -> tuple[tuple | None, Iterable[tuple]]:
        return state, ()


def _value(v):
    """A cell as Python has it: nulls are None, numbers aren't numpy's."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return v.item() if hasattr(v, "item") else v


class _Processor(StatefulProcessor):
    def __init__(self, steps: Steps, keys: list[str], kinds: dict[str, str], event: bool, waits: bool):
        self.steps, self.keys, self.event, self.waits = steps, keys, event, waits
        self.columns = ["t_us", "frame", *steps.reads]
        self.rows = ", ".join(f"{c} {kinds[c]}" for c in self.columns)
        self.names = [*keys, *(c.split()[0] for c in steps.out.split(", "))]
        self.empty = (None,) * (steps.state.count(", ") + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.steps.state}, seen_us long")
        self.timer = handle.getValueState("timer", "at_ms long")
        self.waiting = handle.getListState("waiting", self.rows)

    def close(self) -> None:
        pass

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.event else times.getCurrentProcessingTimeInMs()

    def _run(self, key: tuple, rows: list[tuple], now: int, rest: list[tuple] = ()) -> Iterator[pd.DataFrame]:
        """Steps over the rows, then what is due by now, then the next timer."""
        *held, seen = self.kept.get() if self.kept.exists() else (*self.empty, -(1 << 62))
        state = tuple(held) if held[-1] is not None else None
        told: list[tuple] = []
        for r in sorted(rows, key=self.steps.order):
            if r[0] >= seen:
                seen = r[0]
                state, new = self.steps.row(state, now, *r)
                told += new
        at = self.steps.wakes(state)
        if at is not None and at <= now:
            state, new = self.steps.woken(state, now)
            told += new
            at = self.steps.wakes(state)
        self.kept.update((*(self.empty if state is None else state), seen))
        due = [t for t in (at, min((r[0] // 1000 for r in rest), default=None)) if t is not None]
        self._wake(min(due) if due else None)
        if told:
            yield pd.DataFrame([(*key, *r) for r in told], columns=self.names)

    def _wake(self, at: int | None) -> None:
        """One timer a key."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(map(_value, r)) for part in rows for r in part[self.columns].itertuples(index=False)]
        if not self.waits:
            yield from self._run(key, new, self._now(timerValues))
            return
        self.waiting.appendList(new)
        first = min(r[0] for r in new) // 1000
        at = self.timer.get()[0] if self.timer.exists() else None
        if at is None or first < at:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = self._now(timerValues)
        ready, rest = [], []
        if self.waits:
            for r in self.waiting.get():
                (ready if r[0] // 1000 <= now else rest).append(tuple(r))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield from self._run(key, ready, now, rest)


def stepped(df: DataFrame, steps: Steps, keys: tuple[str, ...] = ("session",), late: str | None = None, waits: bool | None = None, timers: bool = False) -> DataFrame:
    """keys and the columns of steps.out, from a stream with the keys, t_us, frame and the columns steps reads.

    late: by how much rows may be late ("10 seconds"), the watermark's span. waits: whether rows wait for it; they do, if it is given. timers:
    whether ``wakes`` is asked; on the processing clock if there is no watermark.
    """
    rows = df.select(*keys, "t_us", "frame", *steps.reads)
    kinds = dict(rows.dtypes)
    run = _Processor(steps, list(keys), kinds, late is not None, late is not None if waits is None else waits)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), steps.out])
    if late is None:
        return rows.groupBy(*keys).transformWithStateInPandas(run, out, "append", "ProcessingTime" if timers else "None")
    timed = rows.withColumn("event_time", F.timestamp_micros("t_us")).withWatermark("event_time", late)
    return timed.groupBy(*keys).transformWithStateInPandas(run, out, "append", "EventTime")
