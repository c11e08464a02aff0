"""Recursive filters as ordered scans.

A filter whose output feeds back can't be a window expression. An ordered scan hash-partitions by
session, sorts within partitions and streams the rows through a small Python step in Arrow batches.
The step takes the columns of a run of rows of one session and gives the new columns for it, so what
is done per row is its own arithmetic; its state starts anew with each session and lives on
between batches. No session is ever held whole, so a recording of any length needs the memory of one batch. Filters
that look back from the end are two scans: the second finds the sessions where the first left them (``dealt``), sorts
them the other way round and needs no exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes lists, the wanted columns of a run of one session's next rows, and gives the lists of the new columns.
Step = Callable[..., tuple[list, ...]]

_TYPES = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _runs(keys: list[list]) -> Iterator[tuple[int, int, tuple]]:
    """Start, end and key of each run of rows with equal keys; a null is a key like any other."""
    rows = list(zip(*keys))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield start, i, rows[start]
            start = i


def ordered_scan(df: DataFrame, start: Callable[[], Step], reads: list[str], adds: str, keys: tuple[str, ...] = ("session",), order: str = "frame", descending: bool = False, dealt: bool = False) -> DataFrame:
    """df with the columns of ``adds`` (a DDL list), made by ``start()``'s step over each key's rows in order.

    Null keys are a session too. dealt: df comes from a scan by the same keys, so each session lies in one partition already.
    """
    kept = [c for c in df.columns if c not in {a.split()[0] for a in adds.split(", ")}]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*kept).dtypes), adds])
    names = [a.split()[0] for a in adds.split(", ")]
    kinds = [_TYPES[a.split()[1]] for a in adds.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in reads]
            out: list[list] = [[] for _ in names]
            for first, last, own in _runs([b.column(c).to_pylist() for c in keys]):
                if own != key or step is None:
                    key, step = own, start()
                for made, new in zip(out, step(*(c[first:last] for c in columns))):
                    made += new
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*b.schema.names, *names])

    by = [F.desc(order) if descending else F.asc(order)]
    rows = df.select(*kept)
    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *by).mapInArrow(scan, schema)
