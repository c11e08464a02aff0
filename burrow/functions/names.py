"""What file names, headers and body-part names tell, as Column expressions.

Defined results: null in, null out, but for header picks, which give the empty text when nothing is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of session files that aren't part of the stem, in the order in which they go.
STEM_ENDINGS = ("_video_data", "_tracking", "_data", "_retracked", "_annotated")
# Names of the head end, of the body end, and words for either, each in order of preference.
HEAD_NAMES = ("head", "nose", "snout", "headcentre", "head_center")
BODY_NAMES = ("tail_base", "tailbase", "tail", "tail1", "body", "mid_back", "center", "centre", "mouse_center", "back")
FOLLOWED_NAMES = ("center", "centre", "body", "middle", "back")
# Zone names that are taken for body parts.
PART_WORDS = ("center", "centre", "head", "tail", "tailbase", "nose", "snout", "body", "neck", "back", "middle")
# Header keys of the identity columns.
IDENTITY_KEYS = {"Group": ("group", "grp", "genotype", "treatment"), "Sex": ("sex",), "Cage": ("cage",), "Subgroup": ("subgroup", "sub_group", "run")}


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def session_stem(path: Column) -> Column:
    """The base name without the endings of session files."""
    return reduce(lambda s, e: F.regexp_replace(s, f"{e}$", ""), STEM_ENDINGS, base_name(path))


def output_stem(path: Column) -> Column:
    """The base name with ``_video_data`` taken out: what follows after a dash stays, anything else goes with it."""
    name = base_name(path)
    dashed = F.regexp_replace(name, r"_video_data_?-", "-")
    cut = F.rtrim(F.split_part(name, F.lit("_video_data"), F.lit(1)), F.lit("-_"))
    return F.when(name.rlike("_video_data_?-"), dashed).when(F.contains(name, F.lit("_video_data")), F.coalesce(F.nullif(cut, F.lit("")), name)).otherwise(name)


def dated(stem: Column) -> Column:
    """date (ISO), time and subject that a file's stem shows: 20xx dates, six digits of time after the tenth letter, the first part."""
    date, time = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})", r"(?:^|[-_])(\d{2})(\d{2})(\d{2})(?:$|[-_])"
    late = F.when(F.length(stem) > 10, F.substring(stem, 11, 1 << 20)).otherwise(stem)
    joined = lambda s, p, sep: F.when(s.rlike(p), F.concat_ws(sep, *(F.regexp_extract(s, p, i) for i in (1, 2, 3))))
    subject = F.nullif(F.trim(F.get(F.split(stem, "[-_]"), 0)), F.lit(""))
    return F.struct(joined(stem, date, "-").alias("date"), joined(late, time, ":").alias("time"), subject.alias("subject"))


def run_date(run_id: Column) -> Column:
    """The date of a run id that starts with eight digits; the empty text without them."""
    return F.when(run_id.rlike(r"^\d{8}"), F.regexp_replace(F.substring(run_id, 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(F.when(run_id.isNotNull(), F.lit("")))


def picked(header: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys' values that isn't blank, keys compared without case; the empty text if there is none."""
    low = F.transform_keys(header, lambda k, _: F.lower(F.trim(k)))
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(low, F.lit(k.lower()))), F.lit("")) for k in keys), F.lit(""))


def filled(primary: Column, fallback: Column) -> Column:
    """The primary value, or the fallback where it is blank."""
    return F.coalesce(F.nullif(F.trim(primary), F.lit("")), fallback, F.lit(""))


def _plain(names: Column) -> Column:
    return F.transform(names, lambda n: F.replace(F.lower(F.trim(n)), F.lit(" "), F.lit("_")))


def first_named(names: Column, wanted: tuple[str, ...]) -> Column:
    """The first wanted name that is there, as it is spelled there; null if none is."""
    plain = _plain(names)
    found = F.get(F.filter(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(plain, w)), 0)
    return F.get(names, (F.array_position(plain, found) - 1).cast("int"))


def ends(names: Column) -> Column:
    """head and body, the two ends of an animal by name; both null unless both are known and differ."""
    head, body = first_named(names, HEAD_NAMES), first_named(names, BODY_NAMES)
    both = head.isNotNull() & body.isNotNull() & (head != body)
    return F.struct(F.when(both, head).alias("head"), F.when(both, body).alias("body"))


def followed_part(names: Column) -> Column:
    """The part that a single-animal measure follows: a middle one by name, else the first."""
    return F.coalesce(first_named(names, FOLLOWED_NAMES), F.get(names, 0))


def mirror_pairs(names: Column) -> Column:
    """Pairs of places of parts whose names differ by side alone, the left one first in the list."""
    low = F.transform(names, F.lower)
    sides = ((r"^left[_\- ]?", r"^right[_\- ]?"), (r"[_\- ]?left$", r"[_\- ]?right$"), (r"^l[_\- ]", r"^r[_\- ]"), (r"[_\- ]l$", r"[_\- ]r$"))

    def opposite(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x | y, (a.rlike(p) & b.rlike(q) & (F.regexp_replace(a, p, "") == F.regexp_replace(b, q, "")) for p, q in sides))

    places = F.sequence(F.lit(0), F.size(names) - 1)
    pairs = F.transform(places, lambda i: F.transform(F.filter(places, lambda j: (j > i) & opposite(F.get(low, i), F.get(low, j))), lambda j: F.struct(i.alias("left"), j.alias("right"))))
    return F.when(F.size(names) > 0, F.flatten(pairs))


def renamed_zones(zones: DataFrame, parts: list[str], name: str = "name") -> DataFrame:
    """zones (session, name) with analysed: a name that is a body part's gets ``_arm`` if a sibling ends so, else ``_zone``, unless that would be a duplicate."""
    taken = F.array(*(F.lit(p.lower()) for p in dict.fromkeys([*parts, *PART_WORDS])))
    own = Window.partitionBy("session")
    low = F.lower(name)
    ending = F.when(F.max(low.endswith("_arm")).over(own), F.lit("_arm")).otherwise(F.lit("_zone"))
    new = F.concat(F.col(name), ending)
    free = ~F.array_contains(F.collect_set(name).over(own), new)
    return zones.withColumn("analysed", F.when(F.array_contains(taken, low) & free, new).otherwise(F.col(name)))


def chosen_state(frames: DataFrame, columns: tuple[str, ...] = ("state", "stage"), out: str = "stage") -> DataFrame:
    """frames with one state column for each session: the first of the columns that has any value there."""
    own = Window.partitionBy("session")
    has = [F.max(F.col(c).isNotNull()).over(own) for c in columns]
    return frames.withColumn(out, F.coalesce(*(F.when(h, F.struct(F.col(c).alias("v"))) for h, c in zip(has, columns)))["v"])


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating columns rounded; others untouched."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def ordered(df: DataFrame, *by: str, newest: bool = False) -> DataFrame:
    """Result order: ascending with absent values first, or descending for lists that start with the newest."""
    return df.orderBy(*(F.desc_nulls_last(c) if newest else F.asc_nulls_first(c) for c in by))
