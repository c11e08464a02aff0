"""Scalar parsing and formatting rules of session files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "absent".
ABSENT = ("", "na", "n/a", "none", "null", "nan")


def is_absent(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*ABSENT)


def number(c: Column) -> Column:
    """The cell as a number; null if it is absent or isn't one."""
    parsed = c.try_cast("double")
    return F.when(~is_absent(c) & ~F.isnan(parsed), parsed)


def whole(c: Column) -> Column:
    """The cell as an integer, by way of a number."""
    return number(c).cast("long")


def elapsed_ms(c: Column) -> Column:
    """``MM:SS.mmm`` or ``HH:MM:SS.mmm`` in ms; a bare number is ms already."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(is_absent(c), F.lit(None).cast("double")).when(F.contains(c, F.lit(":")), F.round(total * 1000, 3)).otherwise(F.trim(c).try_cast("double"))


def elapsed_s(c: Column) -> Column:
    """The dialect in which a bare number is seconds; result in ms."""
    return F.when(F.contains(c, F.lit(":")), elapsed_ms(c)).otherwise(number(c) * 1000)


def format_elapsed(ms: Column) -> Column:
    """ms as ``MM:SS.mmm``; minutes aren't wrapped."""
    whole_ms = F.round(ms).cast("long")
    return F.when(whole_ms.isNotNull(), F.format_string("%02d:%02d.%03d", F.floor(whole_ms / 60000), F.floor(whole_ms / 1000) % 60, whole_ms % 1000))


def last_state(c: Column) -> Column:
    """The last of bar-joined states; ``-`` (no change) is empty, a leading ``State:`` goes."""
    last = F.trim(F.regexp_replace(F.element_at(F.split(c, "\\|"), -1), "^State:", ""))
    return F.when(last == "-", F.lit("")).otherwise(last)


def escaped(c: Column) -> Column:
    """Tab, line feed and carriage return as two characters each."""
    return F.replace(F.replace(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def json_safe(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def text_hash(c: Column) -> Column:
    """The 32-bit times-33 hash of the text's UTF-8 bytes, as 8 hex digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    h = F.aggregate(pairs, F.lit(5381).cast("long"), lambda acc, p: (acc * 33 + F.conv(p, 16, 10).cast("long")) % (1 << 32))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def folder_date(c: Column) -> Column:
    """A date folder: ISO, or day, month and two digits of the year."""
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")), F.when(c.rlike(r"^\d{6}$"), F.try_to_date(c, "ddMMyy")))


def numbered_stem(c: Column) -> Column:
    """A zone's name without its trailing number or letter, for region suggestions."""
    return F.regexp_replace(c, r"[ _-]?(\d+|[A-Za-z])$", "")


def px_per_cm(length_px: Column, length: Column, unit: Column) -> Column:
    """Scale from a drawn line; lines under one pixel don't count."""
    cm = length * F.when(unit == "mm", 0.1).when(unit == "m", 100.0).when(unit == "in", 2.54).otherwise(1.0)
    return F.when((length_px >= 1) & (cm > 0), length_px / cm)


def px_per_mm(length_px: Column, length_mm: Column, length: Column, unit: Column) -> Column:
    """Scale of a calibration zone: its own length in mm, else a length in a unit (mm if blank or unknown); null unless both are positive."""
    unit = F.lower(F.coalesce(F.nullif(unit, F.lit("")), F.lit("mm")))
    mm = F.coalesce(length_mm, length * F.when(unit == "cm", 10.0).when(unit == "m", 1000.0).when(unit == "in", 25.4).otherwise(1.0))
    return F.when((mm > 0) & (length_px > 0), length_px / mm)


def m_per_px(scale: Column, meta: Column) -> Column:
    """Metres a pixel from a scale's JSON text, else from the file's own (JSON text or number); 1 where neither says.

    A scale is a number (pixels a cm), an object that has one under a known name, an object with length (cm) and values (two points, or four numbers), or four
    numbers of a line that is 22 cm long.
    """

    def pixels_a_cm(text: Column) -> Column:
        fields = F.from_json(text, "map<string,string>")
        named = F.coalesce(*(fields[k].try_cast("double") for k in ("pix_per_cm", "pixels_per_cm", "px_per_cm", "pixpercm")))
        flat = lambda v: F.coalesce(F.from_json(v, "array<double>"), F.flatten(F.from_json(v, "array<array<double>>")))
        far = lambda p: F.when(F.size(p) >= 4, F.hypot(F.get(p, 2) - F.get(p, 0), F.get(p, 3) - F.get(p, 1))).when(F.size(p) == 2, F.abs(F.get(p, 1) - F.get(p, 0)))
        drawn = far(flat(fields["values"])) / F.when(fields["length"].try_cast("double") > 0, fields["length"].try_cast("double"))
        line = F.when(F.size(flat(text)) >= 4, far(flat(text)) / 22.0)
        found = F.when(text.rlike(r"^\s*\{"), F.coalesce(named, drawn)).when(text.rlike(r"^\s*\["), line).otherwise(text.try_cast("double"))
        return F.when(found != 0, found)

    own = F.coalesce(pixels_a_cm(scale), pixels_a_cm(meta))
    return F.when(own > 0, 0.01 / own).otherwise(1.0)


def rate_label(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit("min"))
