"""Token-id shards with a minimal perfect hash index over their document keys.

A store is a folder of pairs ``part-NNNNN-of-MMMMM.ids`` and ``.idx`` and the table ``manifest`` (Parquet),
one row per shard. The ``.ids`` file is the raw
id payload, little-endian, 2 bytes an id where the vocabulary allows, documents in ascending
order of their keys, each closed by the end id. The ``.idx`` file is little-endian, too:

* a header of six 64-bit numbers: documents, documents without a key, distinct keys, buckets, bytes an id, ids;
* ``seeds`` (32 bits each): one displacement per bucket of the minimal perfect hash. Keys hash to buckets of about
  four; buckets are placed largest first, each with the first displacement that sends its keys to
  free slots, so n distinct keys fill n slots exactly;
* ``slots``: for each slot, ``fingerprint`` (32 bits of another hash of the key; a key that isn't stored is told
  apart with all but 2^-32 probability, and never by a scan), ``count`` and ``first``: how many documents the key has
  and where they begin in ascending order. Rows without a key come first and have no slot;
* ``offsets``: id offset of each document, closed by the total.

Keys themselves aren't stored. Looking a key up (``Shard.get``) reads the header, a seed, a slot, its offsets and one slice of the
payload, each by a ranged read, whatever the size of the shard. ``fetch`` looks many keys up; a task that has many keys of
one shard reads that shard's index once and neighbouring slices together.

Defined results: a null text is empty and stores its end id; repeated keys keep all their rows, in
the order of their texts' hashes, and may reach over several shards; an empty table makes a store without shards.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burrow.llm.encoding import word_encoder
from burrow.llm.textual import column, mixed, prepare, written

KEYS_PER_BUCKET = 4
HEADER = 6
SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("first", "<u8")])
MANIFEST = "shard string, part int, documents long, keyless long, tokens long, first_key long, last_key long"
_MANIFEST = pa.schema([("shard", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("keyless", pa.int64()), ("tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: What a row counts besides its text when shards are cut.
ROW_BYTES = 64
#: Neighbouring slices are read together up to so many ids.
READ_IDS = 1 << 21


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys + seeds * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(buckets)).astype(np.int64)


def _print(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, with a fingerprint in each slot."""

    seeds: np.ndarray
    fingerprints: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the slot of each key."""
        keys = keys.astype(np.uint64)
        n = len(keys)
        seeds = np.zeros(max(1, -(-n // KEYS_PER_BUCKET)), np.uint64)
        slots = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        bucket = _bucket(keys, len(seeds))
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(seeds))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        trial = np.arange(64, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[starts[b] : starts[b + 1]]
            base = 0
            while True:
                tried = trial + np.uint64(base)
                at = _slots(keys[own][:, None], tried[None, :], n)
                fits = free[at].all(axis=0)
                if len(own) > 1:
                    s = np.sort(at, axis=0)
                    fits &= (s[1:] != s[:-1]).all(axis=0)
                if fits.any():
                    k = int(fits.argmax())
                    break
                base += len(trial)
                trial = np.arange(min(2 * len(trial), 1 << 14), dtype=np.uint64)
            trial = np.arange(64, dtype=np.uint64)
            seeds[b], slots[own] = base + k, at[:, k]
            free[at[:, k]] = False
        prints = np.zeros(n, np.uint32)
        prints[slots] = _print(keys)
        return cls(seeds, prints), slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where a key isn't stored."""
        n = len(self.fingerprints)
        if not n:
            return np.full(len(keys), -1)
        k = keys.astype(np.int64).view(np.uint64)
        slots = _slots(k, self.seeds[_bucket(k, len(self.seeds))].astype(np.uint64), n)
        return np.where(self.fingerprints[slots] == _print(k), slots, -1)


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI; also for schemes that only pyarrow's Hadoop bridge knows."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def _index(keys: list[int | None], lengths: list[int], width: int) -> bytes:
    known = np.array([k for k in keys if k is not None], np.int64)
    keyless = len(keys) - len(known)
    distinct, at, count = np.unique(known, return_index=True, return_counts=True)
    index, slots = PerfectHash.of(distinct.view(np.uint64))
    table = np.zeros(len(distinct), SLOT)
    table["fingerprint"] = index.fingerprints
    table["first"][slots], table["count"][slots] = at + keyless, count
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    header = np.array([len(keys), keyless, len(distinct), len(index.seeds), width, offsets[-1]], "<u8")
    return header.tobytes() + index.seeds.astype("<u4").tobytes() + table.tobytes() + offsets.tobytes()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encodes every document and writes the store; returns its manifest, one row per shard, with the ids before it (start).

    Documents are range-partitioned by key into shards of about ``shard_bytes`` of text and encoded where
    they are written, so texts cross the network once and ids never do. A task writes the payload as it goes and holds
    keys and lengths only. Files appear under their names when they are whole, so a lost or repeated task leaves no half.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    weight = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("w")).first()["w"] or 0
    shards = max(1, -(-weight // shard_bytes))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        name = f"part-{part:05d}-of-{shards:05d}"
        fs, base = _filesystem(path)
        stem = posixpath.join(base, name)
        keys: list[int | None] = []
        lengths: list[int] = []
        out = None
        for b in batches:
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{stem}.ids.{attempt}")
            keys += b.column(0).to_pylist()
            for text in b.column(1).cast(pa.binary()).to_pylist():
                ids = encoder.ids(text).tobytes() + end
                out.write(ids)
                lengths.append(len(ids) // encoder.dtype.itemsize)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{stem}.idx.{attempt}") as f:
                f.write(_index(keys, lengths, encoder.dtype.itemsize))
            for kind in ("ids", "idx"):
                fs.move(f"{stem}.{kind}.{attempt}", f"{stem}.{kind}")
            known = [k for k in keys if k is not None]
            row = [name, part, len(keys), len(keys) - len(known), sum(lengths), min(known, default=None), max(known, default=None)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MANIFEST)], schema=_MANIFEST)

    ordered = (F.asc_nulls_first("doc_id"), "tie")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # rows alike in key and text may be very many: where they come from parts them
    ranged = rows.withColumn("from", F.spark_partition_id()).repartitionByRange(shards, *ordered, "from").sortWithinPartitions(*ordered, F.asc_nulls_first("text"))
    made = written(ranged.drop("from").mapInArrow(store, MANIFEST), "shards")
    # ids before each shard: of whole groups of shards, then within the group
    grouped = made.withColumn("group", F.floor(F.col("part") / 4096))
    totals = grouped.groupBy("group").agg(F.sum("tokens").alias("all"))
    before = totals.select("group", (F.sum("all").over(Window.orderBy("group")) - F.col("all")).alias("earlier"))
    within = F.sum("tokens").over(Window.partitionBy("group").orderBy("part")) - F.col("tokens")
    manifest = grouped.withColumn("within", within).join(before, "group").select(*made.columns, (F.col("earlier") + F.col("within")).alias("start"))
    manifest.coalesce(1).sortWithinPartitions("part").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


class Shard:
    """One shard, opened for keyed access by ranged reads."""

    def __init__(self, stem: str):
        fs, base = _filesystem(stem)
        self.ids, self.idx = fs.open_input_file(f"{base}.ids"), fs.open_input_file(f"{base}.idx")
        self.documents, self.keyless, self.keys, self.buckets, width, _ = (int(x) for x in self._read("<u8", 0, HEADER))
        self.dtype = np.dtype(f"<u{width}")
        self.at_slots = 8 * HEADER + 4 * self.buckets
        self.at_offsets = self.at_slots + SLOT.itemsize * self.keys

    def _read(self, kind: object, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.idx.read_at(np.dtype(kind).itemsize * n, start), kind)

    def close(self) -> None:
        self.ids.close()
        self.idx.close()

    def offsets(self, first: int, n: int) -> np.ndarray:
        return self._read("<u8", self.at_offsets + 8 * first, n + 1).astype(np.int64)

    def payload(self, start: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.ids.read_at(w * (end - start), w * start), self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row stored under the key; none if there is no such key."""
        if not self.keys:
            return []
        k = np.array([key], np.int64).view(np.uint64)
        seed = self._read("<u4", 8 * HEADER + 4 * int(_bucket(k, self.buckets)[0]), 1).astype(np.uint64)
        slot = self._read(SLOT, self.at_slots + SLOT.itemsize * int(_slots(k, seed, self.keys)[0]), 1)[0]
        if slot["fingerprint"] != _print(k)[0]:
            return []
        o = self.offsets(int(slot["first"]), int(slot["count"]))
        ids = self.payload(o[0], o[-1])
        return [ids[a:b] for a, b in zip(o[:-1] - o[0], o[1:] - o[0])]

    def index(self) -> tuple[PerfectHash, np.ndarray]:
        """The whole hash and slot table, for many look-ups."""
        slots = self._read(SLOT, self.at_slots, self.keys)
        return PerfectHash(self._read("<u4", 8 * HEADER, self.buckets), slots["fingerprint"]), slots

    def slices(self, positions: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of documents at ascending positions; slices near each other come by one read."""
        at = 0
        while at < len(positions):
            start = offsets[positions[at]]
            stop = max(at + 1, int(np.searchsorted(offsets[positions + 1], start + READ_IDS, side="right")))
            ids = self.payload(start, offsets[positions[stop - 1] + 1])
            for p in positions[at:stop]:
                yield ids[offsets[p] - start : offsets[p + 1] - start]
            at = stop


def _facts(shard: Shard, base: int, keys: np.ndarray | None, counts: np.ndarray | None, positions: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids_crc32 of documents at ascending positions."""
    crc = np.fromiter((zlib.crc32(s.astype("<u4").tobytes()) for s in shard.slices(positions, offsets)), np.int64, len(positions))
    ids = pa.nulls(len(positions), pa.int64()) if keys is None else pa.array(np.repeat(keys, counts), pa.int64())
    starts = offsets[positions]
    yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts), pa.array(offsets[positions + 1] - starts), pa.array(crc)], schema=_FOUND)


def fetch(keys: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as uint32) of every row stored under the keys (column doc_id).

    Keys are range-partitioned, so a task needs few shards: those whose key ranges, in the manifest, meet its own. Each key goes through
    the shard's perfect hash and is told from others by its fingerprint; keys that aren't stored give no row. Null keys are ignored.
    """
    spark = prepare(keys.sparkSession)
    sought = keys.select(column(keys, "doc_id", "long")).where("doc_id IS NOT NULL").distinct()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(path)
        for b in batches:
            own = b.column(0).to_numpy()
            near = [("first_key", "<=", int(own.max())), ("last_key", ">=", int(own.min()))]
            held = pa.parquet.read_table(posixpath.join(base, "manifest"), columns=["shard", "part", "start", "first_key", "last_key"], filters=near, filesystem=fs)
            for r in held.sort_by("part").to_pylist():
                shard = Shard(f"{path}/{r['shard']}")
                some = own[(own >= r["first_key"]) & (own <= r["last_key"])]
                hashed, table = shard.index()
                slots = hashed.find(some)
                some, slots = some[slots >= 0], slots[slots >= 0]
                # slots in the order of their documents, and every document of each
                order = np.argsort(table["first"][slots], kind="stable")
                some, first, count = some[order], table["first"][slots[order]].astype(np.int64), table["count"][slots[order]].astype(np.int64)
                positions = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                yield from _facts(shard, r["start"], some, count, positions, shard.offsets(0, shard.documents))
                shard.close()

    parts = max(1, spark.read.parquet(f"{path}/manifest").count())
    return sought.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(look, "doc_id long, start long, n_tokens long, ids_crc32 long")


def keyless(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for all rows that have no key, which stand first in their shards."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base, n in zip(*(c.to_pylist() for c in b.columns)):
                shard = Shard(f"{path}/{name}")
                yield from _facts(shard, base, None, None, np.arange(n), shard.offsets(0, n))
                shard.close()

    held = spark.read.parquet(f"{path}/manifest").where("keyless > 0").select("shard", "start", "keyless")
    return held.repartition("shard").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, path: str, key: int) -> list[np.ndarray]:
    """The ids of every row stored under the key, from the shards whose key range holds it."""
    held = manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part").select("shard").collect()
    return [ids for r in held for ids in Shard(f"{path}/{r['shard']}").get(key)]
