"""Small helpers that the text operators share.

Words come in two kinds, both defined on UTF-8 bytes so that a whole text is cut by two C-level
calls: *runs* are maximal runs without ASCII white space, *alnum words* are maximal runs of
ASCII letters, ASCII digits and anything beyond ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.scratch import released, scratch, shared_dir, written  # noqa: F401

#: Bytes of one Arrow batch sent to Python; long texts then mean fewer rows in a batch.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2_000

_ALNUM = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _ALNUM[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _ALNUM[_c] = _c + 32
ALNUM = bytes(_ALNUM)


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def run_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low and high bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Texts are hashed in blocks of about so many bytes, cut between words.
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


class WordHashes:
    """64-bit hashes of all words of a text, in one sweep over its bytes.

    A word's hash is the sum of a random number per byte times a power of the byte's place, modulo
    2^64. Sums over the whole text give those of its words as differences; powers of an odd number can be
    divided out again, so a word hashes alike wherever it stands. No word becomes a Python object, but for those of
    more than ``LONG`` bytes: such sums can be made to collide with very long words, so these get another hash.
    """

    LONG = 64

    def __init__(self, kind: str):
        numbers = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.gap = np.zeros(256, bool)
        for c in range(128):
            self.gap[c] = ALNUM[c : c + 1] == b" " if kind == "alnum" else c in b" \t\n\x0b\x0c\r"
        for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            numbers[c] = numbers[c + 32]
        self.numbers = np.where(self.gap, np.uint64(0), numbers)
        self._grow(BLOCK_BYTES)

    def _grow(self, n: int) -> None:
        self.powers = np.cumprod(np.full(n, _BASE, np.uint64))
        self.inverses = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def of(self, text: bytes | None) -> np.ndarray:
        """One hash per word, in order."""
        if not text:
            return np.empty(0, np.uint64)
        b = np.frombuffer(text, np.uint8)
        gap = self.gap[b]
        if len(b) <= BLOCK_BYTES:
            return self._block(b, gap)
        gaps = np.flatnonzero(gap)
        out, at = [], 0
        while at < len(b):
            cut = len(b)
            if cut - at > BLOCK_BYTES:
                k = int(np.searchsorted(gaps, at + BLOCK_BYTES))
                cut = int(gaps[k]) if k < len(gaps) else len(b)
            out.append(self._block(b[at:cut], gap[at:cut]))
            at = cut
        return np.concatenate(out)

    def _block(self, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
        n = len(b)
        if n > len(self.powers):
            self._grow(n)
        turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edges = np.concatenate([[0] if not gap[0] else [], turns, [n] if not gap[-1] else []]).astype(np.int64)
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.numbers[b] * self.powers[:n], out=sums[1:])
        out = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        for i in np.flatnonzero(ends - starts > self.LONG):
            out[i] = xxhash.xxh64_intdigest(b[starts[i] : ends[i]].tobytes().lower())
        return out


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, one for each start; empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
        out ^= out >> np.uint64(32)
    return mixed(out)


def column(df: DataFrame, name: str, kind: str):
    """The named column cast to kind, or nulls if df has no such column."""
    return (df[name] if name in df.columns else F.lit(None)).cast(kind).alias(name)


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes and gives executors this package if they can't import it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = Path(__file__).resolve().parents[2]
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(root) not in seen and not getattr(context, "_burrow_sent", False):
        out = Path(tempfile.mkdtemp(prefix="burrow-")) / "burrow.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted((root / "burrow").rglob("*.py")):
                z.write(p, p.relative_to(root))
        context.addPyFile(str(out))
        context._burrow_sent = True
    return spark


def per_worker(name: str, make):
    """An object kept by the Python worker from task to task."""
    kept = sys.modules[__name__].__dict__.setdefault("_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]
