"""Token counts of a sentence-piece vocabulary without encoding every word again and again.

A text is cut where no token can reach across: before each run of spaces and before each line end.
``PieceCounts`` proves this for the vocabulary at hand: no piece has a space after another
character and none holds a line end. So the count of a text is the sum of the counts of its
segments. Segments that the vocabulary encodes as one token, proved offline by encoding each
vocabulary string alone, count 1 with no merging; the merges run only for the rest, once for each
segment a worker remembers. If the proof fails for some vocabulary, whole texts are encoded.

Defined results: null counts as the empty text, which has no tokens; repeated rows count each; an
empty table gives no rows; other columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import column, per_worker, prepare

SPACE = "▁"
_JOIN = "\x00"


class PieceCounts(dict):
    """Segment -> tokens. A segment starts with an implied space, or with NUL and a line end; long ones aren't remembered."""

    LONG = 64

    def __init__(self, path: str, most: int = 1_200_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        piece = self.library
        strings = [piece.id_to_piece(i) for i in range(piece.get_piece_size()) if not (piece.is_byte(i) or piece.is_control(i) or piece.is_unknown(i))]
        self.splits = not any(SPACE in s.lstrip(SPACE) or "\n" in s for s in strings) and self.library.encode("a  b\n c", out_type=str)[0].startswith(SPACE) and len(self.library.encode("a", out_type=str)) == 1
        #: What counts 1 without merging: vocabulary strings that start with one space and encode alone as themselves.
        words = [s[1:] for s in strings if s.startswith(SPACE) and len(s) > 1 and s[1] != SPACE]
        self.whole = {w for w, ids in zip(words, self.library.encode(words, num_threads=1)) if len(ids) == 1}
        self.update(dict.fromkeys(self.whole, 1))

    def __missing__(self, segment: str) -> int:
        if segment.startswith(_JOIN):
            n = len(self.library.encode(segment[1:])) - 1
        elif not segment:
            n = 1
        else:
            n = len(self.library.encode(segment))
        if len(segment) > self.LONG:
            return n
        if len(self) >= self.most:  # frequent segments came early and stay
            for late in list(self)[self.most // 2 :]:
                del self[late]
        self[segment] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits or _JOIN in text or SPACE in text:
            return len(self.library.encode(text))
        parts = text.replace("\n", " " + _JOIN + "\n").split(" ")
        if "" in parts:  # runs of spaces: they belong to the segment after them
            merged, run = [], 0
            for i, p in enumerate(parts):
                if p == "" and i < len(parts) - 1 and not parts[i + 1].startswith(_JOIN):
                    run += 1
                    continue
                merged.append(" " * run + p)
                run = 0
            parts = merged
        return sum(map(self.__getitem__, parts))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit per row."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker(f"pieces {model}", lambda: PieceCounts(model))
        for b in batches:
            n = [counts.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], schema=schema)

    rows = docs.select(column(docs, "doc_id", "long"), F.coalesce(F.octet_length(column(docs, "text", "string")), F.lit(0)).cast("long").alias("n_bytes"), column(docs, "text", "string"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
