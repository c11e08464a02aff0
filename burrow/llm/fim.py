"""Fill-in-middle transformation: texts are cut at unit borders into prefix, middle and suffix, and put in another order.

A unit grammar is translated to a boundary (``boundary``): a zero-width regular expression that looks at
the class of characters before a place and at that behind it, so Spark's ``split`` takes nothing away and the pieces
joined give the text again. At a text's ends there is a character on one side only, so no boundary is there and no piece is empty; an empty text, which
split would give back as one piece, has none. All is DataFrame functions.

Places and form come from the digest of a seed and the document's id, so they are the same in each run and on every machine.

Defined results: a null text is empty; a null doc_id counts as an empty string in the digest; an empty text or one that
holds a marker stays as it is (plain); repeated rows give the same each; an empty table gives no rows; other columns are
ignored, also those named like a result; texts of any length are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: A unit's grammar: the class of the last character of a unit and that of the first one of the next.
UNITS = {
    "lines": (r"\n", r"[\s\S]"),  # a line ends with its line feed
    "words": (r"\S", r"\s"),  # a word begins with the white space before it
    "sentences": (r"[.!?\u3002]", r"\s"),
    "characters": (r"[\s\S]", r"[\s\S]"),
}


def boundary(unit: str) -> str:
    """The zero-width expression for the places between two units."""
    before, behind = UNITS[unit]
    return f"(?<={before})(?={behind})"


def units(text: Column, unit: str = "lines") -> Column:
    """The text's units in order; joined they are the text. None for an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def _number(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output: one row per document.

    rate: how many of 100 texts are rearranged; spm: how many of 100 of these begin with the suffix.
    """
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, "doc_id", "string"), F.lit("")))
    rows = docs.select(column(docs, "doc_id", "long"), text.alias("text"), units(text, unit).alias("units"), F.sha2(key, 256).alias("digest"))
    places = F.size("units") + 1
    cuts = [_number(F.col("digest"), i) % places for i in (0, 1)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_number(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_number(F.col("digest"), 3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", F.size("units").cast("long").alias("n"), form.alias("form"), F.least(*cuts).cast("int").alias("one"), F.greatest(*cuts).cast("int").alias("two"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    one, two = F.col("one"), F.col("two")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(1), one).alias("p"), part(one + 1, two - one).alias("m"), part(two + 1, F.col("n").cast("int") - two).alias("s"))
    pieces = {"psm": (PREFIX, "p", SUFFIX, "s", MIDDLE, "m"), "spm": (SUFFIX, "s", PREFIX, "p", MIDDLE, "m")}
    joined = {f: F.concat(*(F.col(c) if c in "pms" else F.lit(c) for c in order)) for f, order in pieces.items()}
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", joined["psm"]).otherwise(joined["spm"])
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return rows.select("doc_id", "n", "form", chars("p").alias("prefix_chars"), chars("m").alias("middle_chars"), output.alias("output"))


def restored(rows: DataFrame) -> DataFrame:
    """The rows with the column restored: the text rebuilt from output and form alone.

    The parts hold no marker, and none can arise across their borders, so the three markers cut the output into its parts.
    """
    parts = F.split("output", "<[PSM]>", 4)
    rebuilt = F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return rows.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(rebuilt))
