"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words (one run if it has fewer). A window is
a set of word shingles that a document must contain whole, so of a window's shingles ordered by
rarity the necessary prefix is its rarest one: a document without it can't hold the window. The join
has these steps:

1. Shingle rarity: the number of documents that hold each benchmark shingle, counted over all documents.
2. Prefix tokens: the rarest shingle of each distinct window, with its offset there.
3. Documents look their shingles up in a filter of the prefix tokens, a bit table whose size is bounded
   (``FILTER_BITS``) whatever the size of the benchmark, and send out what passes with the words around it.
4. Spark joins these with the windows on the prefix token.
5. Length and positional bounds: the window must fit between the document's first and last word.
6. Exact check: the document's words there equal the window's, word for word.

The shingle counts of step 1 and the windows of step 4 are grouped and joined by Spark, which
broadcasts them only if they are small; neither is collected. The documents are read twice.

Defined results: null and empty texts have no words and no hits; empty items have no window; items
with equal ids count once per id, a null item_id is no item; repeated documents are reported each; without benchmark rows
nothing is hit; an empty table gives no rows; other columns are ignored, and ``remove_contaminated`` hands them on; texts of any length are looked at whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import WordHashes, alnum_words, column, per_worker, prepare, rolling, written

SHINGLE = 5
FILTER_BITS = 26
#: Candidates that leave a Python worker at once.
SENT_ROWS = 2_000

_WINDOWS = "item_id string, window_id long, length int, words string, token long, k int, at int"


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    return rolling(hashes, k) ^ np.uint64(k)


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """One row per item, distinct window and shingle of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("alnum hashes", lambda: WordHashes("alnum"))
        for b in batches:
            out: list[tuple] = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = alnum_words(text)
                n = min(window, len(w))
                h = hashes.of(text)
                for s in range(len(w) - n + 1 if n else 0):
                    k = min(SHINGLE, n)
                    joined = b" ".join(w[s : s + n]).decode()
                    own = int(rolling(h[s : s + n], n)[0] >> np.uint64(1))
                    out += [(item, own, n, joined, t, k, at) for at, t in enumerate(_shingles(h[s : s + n], k).view(np.int64).tolist())]
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _WINDOWS.split(", ")])

    rows = benchmark.select(column(benchmark, "item_id", "string"), column(benchmark, "text", "string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return written(rows.mapInArrow(cut, _WINDOWS).distinct(), "windows")


class TokenFilter:
    """A bit table of tokens; what isn't set can't be a token."""

    def __init__(self, tokens: DataFrame):
        kinds = tokens.select("k").distinct().collect()
        self.ks = sorted(r["k"] for r in kinds)
        size = 1 << FILTER_BITS
        self.bits = np.zeros(size >> 3, np.uint8)
        if self.ks:
            # one bit number per token, unioned on executors into byte values: at most 2^23 rows of 2 numbers
            bit = F.shiftrightunsigned("token", 64 - FILTER_BITS)
            parts = tokens.select(F.shiftright(bit, 3).cast("int").alias("byte"), bit.bitwiseAND(7).cast("int").alias("i")).selectExpr("byte", "shiftleft(1, i) AS v").groupBy("byte").agg(F.bit_or("v").alias("v")).toArrow()
            self.bits[parts["byte"].to_numpy()] = parts["v"].to_numpy().astype(np.uint8)

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        bit = tokens >> np.uint64(64 - FILTER_BITS)
        return np.flatnonzero(self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)


def _rarity(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, seen: the number of documents that hold each benchmark shingle, over all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(TokenFilter(tokens))  # 2^23 bytes

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, f = per_worker("alnum hashes", lambda: WordHashes("alnum")), shared.value
        for b in batches:
            found = [np.empty(0, np.uint64)]
            for text in b.column(0).cast(pa.binary()).to_pylist():
                h = hashes.of(text)
                for k in f.ks:
                    s = _shingles(h, k)
                    found.append(np.unique(s[f.hits(s)]))
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    counted = docs.select(column(docs, "text", "string")).mapInArrow(held, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("seen"))


def _prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, length, words, token, k, at: each distinct window's rarest shingle (ties: the smaller hash, then the earlier place)."""
    shingles = windows.drop("item_id").distinct()
    counted = shingles.join(_rarity(docs, windows.select("token", "k").distinct()), "token", "left")
    order = F.struct(F.coalesce("seen", F.lit(0)), "token", "at")
    best = counted.groupBy("window_id", "length", "words").agg(F.min_by(F.struct("token", "k", "at"), order).alias("p"))
    return written(best.select("window_id", "length", "words", "p.*"), "prefixes")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """row, doc_id, n_words, start, length, window_id: each occurrence of a window; one row per document has null start."""
    return _hits(docs, _windows(benchmark, window), window)


def _hits(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    spark = prepare(docs.sparkSession)
    prefixes = _prefixes(docs, windows)
    shared = spark.sparkContext.broadcast(TokenFilter(prefixes))  # 2^23 bytes
    reach = window - 1
    kind = "row long, doc_id long, n_words long, token long, pos int, from int, around string"
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("token", pa.int64()), ("pos", pa.int32()), ("from", pa.int32()), ("around", pa.string())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, f = per_worker("alnum hashes", lambda: WordHashes("alnum")), shared.value
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            for row, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                h = hashes.of(text)
                w: list[bytes] = []
                out.append((row, key, len(h), row * 0x1E3779B97F4A7C15 % (1 << 63), None, None, None))
                for k in f.ks:
                    s = _shingles(h, k)
                    for p in f.hits(s).tolist():
                        w = w or alnum_words(text)
                        a = max(0, p - reach)
                        out.append((row, key, len(h), int(s[p : p + 1].view(np.int64)[0]), p, a, b" ".join(w[a : p + k + reach]).decode()))
                        if len(out) >= SENT_ROWS:
                            yield sent()
        yield sent()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, "doc_id", "long"), column(docs, "text", "string"))
    sent = rows.mapInArrow(candidates, kind)
    sides = prefixes.select("token", "length", "words", "at", "window_id")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("around", " "), start - F.col("from") + 1, F.col("length")), " ")
    met = sent.join(sides, "token", "left").withColumn("start", F.when(fits, start))
    same = F.col("start").isNotNull() & (F.when(F.col("start").isNotNull(), there) == F.col("words"))
    return met.where(F.col("pos").isNull() | same).select("row", "doc_id", "n_words", F.when(same, F.col("start")).alias("start"), "length", "window_id")


def measure(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated per row: n_hit words lie in an occurrence of a window."""
    prepare(docs.sparkSession)
    windows = _windows(benchmark, window)
    found = written(_hits(docs, windows, window), "hits")
    place = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    grouped = found.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set(place)).alias("places"))
    # items of a window come in once for each document that has it, after the exact check
    items = windows.groupBy("window_id").agg(F.collect_set("item_id").alias("own"))
    held = found.where("start IS NOT NULL").select("row", "window_id").distinct().join(items, "window_id")
    held = held.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("item_ids"))
    grouped = grouped.join(held, "row", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.greatest(p["end"] - F.greatest(p["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], p["end"]).alias("end")),
    )["n"].cast("long")
    out = grouped.select("doc_id", "n_words", covered.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without any hit, with their columns. A text's verdict depends on itself alone."""
    keyed = docs.select(F.xxhash64(column(docs, "text", "string")).alias("doc_id"), column(docs, "text", "string"))
    bad = written(measure(keyed, benchmark, window).where("contaminated").select(F.col("doc_id").alias("dc_text_hash")).distinct(), "contaminated")
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("dc_row"), F.xxhash64(column(docs, "text", "string")).alias("dc_text_hash"))
    return own.join(bad, "dc_text_hash", "left_anti").select("dc_row.*")
