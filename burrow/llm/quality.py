"""Quality rules: repetition inside a document, and lines that a host repeats across documents.

Everything here is DataFrame functions; no Python runs on executors.

``base_measures`` works row by row. ``line_verdicts`` hashes each normalised line (lower case, inner
white space as one space), counts for each host the distinct texts that hold it, calls a line
boilerplate if more than ``line_share`` of the host's distinct texts and at least ``line_docs`` of
them hold it, and rejects a document as depleted if without such lines fewer than ``least_words``
words remain and at least half of its words went. Counting distinct texts, not rows, keeps a group
of exact copies from making its own lines look like boilerplate. What is kept goes on without its
boilerplate lines; its other lines, blank ones too, stay as they are and in order.

Lines are counted with partial aggregation before each shuffle and the boilerplate lines meet
the documents' lines in an equi-join whose small side Spark sizes from files or splits by AQE, so a
host or a line that holds a third of the rows doesn't gather in one task.

Defined results: a null or empty text has no words, fails the base rules and isn't kept; a null
source is a host of its own; repeated rows are judged each; an empty table gives no rows; other
columns of the input are ignored, and ``reject_low_quality`` hands them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import column, prepare, written

BLANK = " \t\n\x0b\x0c\r"
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _host(df: DataFrame) -> Column:
    source = column(df, "source", "string")
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANK)), BLANKS, " ")))


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines whose hashes are in gone; null for no lines. Blank lines stay."""
    keeps = lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~F.array_contains(gone, _line_hash(x))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), keeps), "\n"))


def base_measures(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to rows with a column text; drops nothing.

    A word is repeated if it lies in a window of 8 words that stands twice or more in the text.
    Each step is its own projection, so the arrays are built once a row.
    """
    text = F.coalesce("text", F.lit(""))
    out = rows.withColumns({"q_words": F.filter(F.split(text, BLANKS), lambda w: w != ""), "q_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")})
    out = out.withColumn("q_runs", F.when(F.size("q_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("q_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("q_words", i, WINDOW)))))
    out = out.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_runs")) < F.size("q_runs"), F.array_sort(F.transform("q_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(e["h"] == F.get("q_sorted", j)["h"], F.lit(False))
    out = out.withColumn("q_starts", F.array_sort(F.transform(F.filter("q_sorted", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform("q_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("q_starts", j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda total, x: total + x)
    return out.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.translate(text, BLANK, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "q_line_words": F.transform(
                "q_lines",
                lambda x: F.struct(
                    _line_hash(x).alias("line"),
                    F.size(F.split(F.btrim(x, F.lit(BLANK)), BLANKS)).alias("words"),
                ),
            ),
        }
    ).drop("q_words", "q_lines", "q_runs", "q_sorted", "q_starts")


def measured(docs: DataFrame, least_words: int, repeat_percent: int, with_text: bool = False) -> DataFrame:
    """doc_id, host, text_hash, the base measures, base_failed and each line's hash and words, the text if asked for; written to the shared folder."""
    rows = docs.select(column(docs, "doc_id", "long"), _host(docs).alias("host"), column(docs, "text", "string"))
    base = base_measures(rows.withColumn("text_hash", F.xxhash64("text")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return written((base if with_text else base.drop("text")).withColumn("base_failed", failed), "quality")


def line_verdicts(base: DataFrame, line_share: float, line_docs: int, least_words: int) -> DataFrame:
    """host, text_hash, gone_lines and depleted of the texts that hold boilerplate lines, from what ``measured`` returns."""
    lines = base.select("host", "text_hash", "n_words", F.explode("q_line_words").alias("x")).select("host", "text_hash", "n_words", "x.line", "x.words")
    hosts = base.groupBy("host").agg(F.count_distinct("text_hash").alias("texts"))
    spread = lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("seen")).where(F.col("seen") >= line_docs)
    common = written(spread.join(hosts, "host").where(F.col("seen") > line_share * F.col("texts")).select("host", "line"), "common-lines")
    texts = lines.join(common, ["host", "line"]).groupBy("host", "text_hash", "n_words").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("gone_lines"))
    # repeated rows of one text add up alike: compare what one of them lost
    copies = base.groupBy("host", "text_hash").agg(F.count("*").alias("rows"))
    lost = texts.join(copies, ["host", "text_hash"]).withColumn("gone", F.col("gone") / F.col("rows"))
    depleted = (F.col("n_words") - F.col("gone") < least_words) & (2 * F.col("gone") >= F.col("n_words"))
    return written(lost.select("host", "text_hash", "gone_lines", depleted.alias("depleted")), "lost-lines")


def judge(docs: DataFrame, least_words: int = 20, repeat_percent: int = 30, line_share: float = 0.1, line_docs: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per row.

    with_text adds clean_text, what is left of a kept text without boilerplate lines; null for the others.
    """
    prepare(docs.sparkSession)
    base = measured(docs, least_words, repeat_percent, with_text)
    verdicts = line_verdicts(base, line_share, line_docs, least_words)
    out = base.drop("q_line_words").join(verdicts, ["host", "text_hash"], "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    if with_text:
        return out.select(*names, F.when(F.col("kept"), without_lines(F.col("text"), F.col("gone_lines"))).alias("clean_text"))
    return out.select(*names)


def reject_low_quality(docs: DataFrame, least_words: int = 20, repeat_percent: int = 30, line_share: float = 0.1, line_docs: int = 20) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns, text without boilerplate lines. A text's verdict depends on its host and itself alone."""
    prepare(docs.sparkSession)
    base = measured(docs, least_words, repeat_percent)
    lost = line_verdicts(base, line_share, line_docs, least_words)
    failed = base.where("base_failed").select("host", "text_hash").distinct().withColumn("q_failed", F.lit(True))
    verdicts = lost.join(failed, ["host", "text_hash"], "full").select(
        F.col("host").alias("q_host"), F.col("text_hash").alias("q_text_hash"), "gone_lines", (F.coalesce("q_failed", F.lit(False)) | F.coalesce("depleted", F.lit(False))).alias("q_rejected")
    )
    text = column(docs, "text", "string")
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("q_row"), _host(docs).alias("q_host"), F.xxhash64(text).alias("q_text_hash"))
    kept = keyed.join(written(verdicts, "verdicts"), ["q_host", "q_text_hash"], "left").where(~F.coalesce("q_rejected", F.lit(False)))
    row = F.col("q_row")
    return kept.select(*((without_lines(row[c].cast("string"), F.col("gone_lines")) if c == "text" else row[c]).alias(c) for c in docs.columns))
