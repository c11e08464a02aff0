"""Best-fit packing of token sequences by the sum-of-squares rule.

A document becomes pieces of at most ``capacity`` tokens (only longer ones are cut). Pieces are
dealt out by hash to tasks of about ``docs_per_task`` documents, and each task packs its own:
for the next piece it looks at the counts N(g) of open sequences with residual gap g and takes the
place, an open sequence or a new one, after which the sum of N(g)^2 is smallest (of equal ones the open one that is left with the smallest gap). The state is one
count per gap and the open sequences' numbers, so memory doesn't depend on the corpus, and what
splitting costs is a few unfilled sequences a task.

Defined results: a null or empty text is one piece holding the end id alone; repeated rows are
packed each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.encoding import word_encoder
from burrow.llm.textual import column, prepare

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document, with the crc32 of its ids as little-endian uint32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = np.append(encoder.ids(text), end_id).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((key, i, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string")).mapInArrow(cut, PIECES)


class SumOfSquares:
    """Open sequences of one task, by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset there for a piece of this length."""
        cap, n = self.capacity, self.counts
        # change[r]: of the sum, if the piece leaves gap r in a sequence of gap r + length; full ones and unused ones don't count
        change = 2 * (n[: cap - length + 1] - n[length:]) + 2
        change[0] -= 1
        change = np.where(n[length:] > 0, change, 1 << 60)
        best = int(change.argmin())
        fresh = 2 * n[cap - length] + 1 if length < cap else 0
        if change[best] <= fresh:
            gap = best + length
            seq = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, seq = cap, self.made
            self.made += 1
        left = gap - length
        if left:
            self.open[left].append(seq)
            n[left] += 1
        return seq, cap - gap


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, docs_per_task: int = 25_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    prepare(docs.sparkSession)
    tasks = max(1, -(-docs.count() // docs_per_task))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = SumOfSquares(capacity)
        for b in batches:
            placed = [bins.place(x) for x in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in list(schema)[:5]), pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                schema=schema,
            )

    # rows alike in everything may be very many: where they come from parts them
    dealt = pieces(docs, tokenizer, end_id, capacity).repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.spark_partition_id()))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(packed, f"{PIECES}, sequence_id long, offset long")
