"""Readers and writers of recorded session files and their side tables.

Session files are text in several dialects, told apart by their header:

* ``hash``: lines ``#key value``, the columns in ``#columns a b c``, zones as JSON between ``#zone_config_begin`` and ``_end``;
* ``columns``: header rows ``0.000<TAB>info<TAB>key<TAB>value``, the columns in ``# a<TAB>b<TAB>c``, zones after ``Zones``;
* ``bmv``: header lines ``B``, ``M`` and ``V`` with JSON, one JSON object per frame;
* ``json``: one JSON object per frame alone; ``plain``: tab-separated frames in the order of ``BASE_COLUMNS``.

All give the same table. Files are read as text, split and spread over tasks; nothing is read on the driver. Many small files are listed and opened by a source
of their own, as Spark's text reader spends most of its time on that; it reads the file systems that pyarrow doesn't know.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burrow.functions.scalars import elapsed_ms, escaped, is_absent, last_state, number

# The columns of a file that doesn't name its own, in order.
BASE_COLUMNS = ("frame_number", "frame_ts_ms", "pose_ts_ms", "mcu_ts_ms", "speed", "location", "pose_array", "stage")
# Other names of these and one more column, in files with a ``# a<TAB>b`` line and in those with ``#columns``.
ALIASES = {
    "frame_number": ("frame", "frames", "frame_idx"),
    "frame_ts_ms": ("actual_ts", "timestamp_ms", "frame_ts", "timestamp", "timestamps", "time", "elapsed", "frame_time"),
    "pose_ts_ms": ("pose_ts",),
    "mcu_ts_ms": ("mcu", "mcu_frame", "mcu_time", "mcu_ts"),
    "speed": ("velocity",),
    "location": ("zone",),
    "pose_array": ("pose", "keypoints"),
    "stage": ("state", "state_name"),
}
HASH_ALIASES = {
    "frame_number": ("frame", "frame_num"),
    "frame_ts_ms": ("elapsed", "capture_elapsed"),
    "pose_ts_ms": ("pose_fw_ms", "mcu_fw_pose_ms"),
    "mcu_ts_ms": ("frame_fw_ms", "mcu_fw_capture_ms", "fw_ms"),
    "speed": ("speed_pxs",),
    "location": ("zone",),
    "pose_array": ("pose",),
    "stage": ("state",),
    "capture_host_ns": ("host_mono_ns",),
}
CANONICAL = (*BASE_COLUMNS, "capture_host_ns")
# Second cells of rows that are no frames.
EVENT_WORDS = ("info", "event", "state", "print", "variable", "warning", "error", "trigger", "marker")
# Header keys with another name.
HEADER_NAMES = {"session_start": "start_time"}
#: Fields of JSON frames, first choice first.
_JSON = {
    "frame_number": ("frame_number", "frame", "frames"),
    "frame_ts_ms": ("frame_ts_ms", "t", "time", "timestamps"),
    "speed": ("speed",),
    "location": ("location", "zone"),
    "pose_array": ("pose_array", "pose", "poses"),
    "stage": ("stage", "state", "state_name"),
}
# Characters that Spark escapes in folder names.
_ODD = r"[\x01-\x1F\x7F\"#%'*/:=?\\{\[\]^]"
_POINT = "struct<x:double,y:double,conf:double>"
_POSE = f"map<string,{_POINT}>"


def _text(spark: SparkSession, path: str, files: str, marked: bool = False) -> DataFrame:
    """file, at (offset of the split, then order in it), line of all files of such names below a path; marked: with mark, false of lines that surely don't tell a layout, or tell nothing new."""
    from burrow.sources import session_source

    if re.fullmatch(r"\*[\w.-]*", files) and session_source.can_read(spark, path):
        return session_source.text_lines(spark, path, files[1:], marked)
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path)
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id"))
    return t.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("line"), *[F.lit(True).alias("mark")] * marked)


def lines(spark: SparkSession, path: str, exclude: str = r"\.pbanalysis/") -> DataFrame:
    """file, line and its place (offset of the split, then order in it) of every session file below a path, but in analysis folders."""
    return _told(_text(spark, path, "*.txt"), exclude)


def _told(text: DataFrame, exclude: str) -> DataFrame:
    return text.where(~F.col("file").rlike(exclude) & (F.trim("line") != ""))


def layout_lines(spark: SparkSession, path: str, exclude: str = r"\.pbanalysis/") -> DataFrame:
    """``lines`` of which those may be missing that say nothing, or nothing new, of their file's layout: few of a file, however many frames it has."""
    return _marked_lines(spark, path, exclude).where("mark").drop("mark")


def _marked_lines(spark: SparkSession, path: str, exclude: str = r"\.pbanalysis/") -> DataFrame:
    """``lines`` with mark, false where a line says nothing, or nothing new, of its file's layout."""
    return _told(_text(spark, path, "*.txt", marked=True), exclude)


def is_frame(line: Column) -> Column:
    """Whether a line is a frame: a JSON object, or cells of which the first is an integer and the second isn't an event word."""
    second = F.lower(F.trim(F.get(F.split(line, "\t", 3), 1)))
    return line.rlike(r"^\s*\{") | (line.rlike(r"^\s*-*\d+\s*\t") & ~second.isin(*EVENT_WORDS))


def _blocks(rows: DataFrame) -> DataFrame:
    """file, begin, end of the zone block of a header."""
    marks = rows.where(F.col("line").startswith("#zone_config_"))
    begin, end = (F.min(F.when(F.col("line").startswith(f"#zone_config_{w}"), F.col("at"))) for w in ("begin", "end"))
    return marks.groupBy("file").agg(begin.alias("begin"), end.alias("end"))


def _header_rows(rows: DataFrame) -> DataFrame:
    """file, at, line of what stands before the first frame, zone blocks left out."""
    ends = rows.where(is_frame(F.col("line")) & ~F.col("line").rlike(r"^\s*\{\s*$")).groupBy("file").agg(F.min("at").alias("first"))
    outside = F.col("begin").isNull() | (F.col("at") < F.col("begin")) | (F.col("at") > F.col("end"))
    h = rows.where(~F.col("line").rlike(r"^\s*-*\d+\t\s*[-\d]")).join(ends, "file", "left").join(_blocks(rows), "file", "left")
    return h.where((F.col("first").isNull() | (F.col("at") < F.col("first")) | F.col("line").startswith("#")) & outside).select("file", "at", "line")


def headers(rows: DataFrame) -> DataFrame:
    """file, header: a map of all that the header says. Of repeated keys the first wins, of ``info`` rows the last, and these win over others."""
    h = _header_rows(rows)
    line = F.col("line")
    hashed, tabbed = r"^#(\w+)\s+(.*\S)\s*$", r"^[^\t]*\tinfo\t([^\t]*)\t([^\t]*)"
    letter, payload = F.substring("line", 1, 1), F.substring(line, 3, 1 << 30)
    fields = F.from_json(payload, "map<string,string>")
    fields = F.when(letter == "V", F.create_map(F.lit("crop"), payload)).when(letter == "M", F.map_filter(fields, lambda k, _: k != "zones")).otherwise(F.map_concat(fields, F.when(fields["fps"].isNotNull(), F.create_map(F.lit("target_fps"), fields["fps"])).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))))
    parts = F.to_json(F.transform(F.split(F.regexp_replace("line", "^body_parts:", ""), ","), F.trim))
    found = F.when(line.rlike(hashed), F.create_map(F.regexp_extract("line", hashed, 1), F.regexp_extract("line", hashed, 2)))
    found = found.when(line.rlike(tabbed), F.create_map(F.regexp_extract("line", tabbed, 1), F.regexp_extract("line", tabbed, 2)))
    found = found.when(line.rlike(r"^[BMV] "), fields).when(line.startswith("body_parts:"), F.create_map(F.lit("body_parts"), parts))
    pairs = h.select("file", "at", line.rlike(tabbed).alias("info"), F.explode(found).alias("name", "value"))
    pairs = pairs.where(~F.col("name").isin("columns", "zone_config_begin", "zone_config_end")).replace(HEADER_NAMES, subset=["name"])
    best = F.coalesce(F.max_by("value", F.when(F.col("info"), F.col("at"))), F.min_by("value", "at"))
    last = pairs.groupBy("file", "name").agg(best.alias("value"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("header"))


def zone_text(rows: DataFrame) -> DataFrame:
    """file, zones: the JSON text of a file's zones, from a block, a ``Zones`` line or an ``M`` line."""
    inside = rows.join(_blocks(rows), "file").where((F.col("at") > F.col("begin")) & (F.col("at") < F.col("end")))
    block = inside.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "").alias("zones"))
    one = rows.where(F.col("line").rlike(r"^Zones(?:3D)?[\t ]") | F.col("line").startswith("M ")).select("file", "at", F.regexp_replace("line", r"^(?:Zones(?:3D)?[\t ]|M )", "").alias("zones"))
    single = one.groupBy("file").agg(F.max_by("zones", "at").alias("zones"))
    return block.unionByName(single.join(block, "file", "left_anti"))


def _marks() -> dict[str, Column]:
    """What a line says of its file's layout: columns as it names them, parts (text of body parts), and whether it is of the hash, bmv or json dialect."""
    line = F.col("line")
    tabs = F.filter(F.transform(F.split(F.regexp_replace("line", "^#+", ""), "\t"), F.trim), lambda n: n != "")
    named = F.when(line.rlike(r"^#\s*[^\t]+\t") & (F.size(tabs) >= 3), tabs).when(line.rlike(r"^#columns\s"), F.split(F.trim(F.regexp_replace("line", r"^#columns\s+", "")), r"\s+"))
    parts = F.when(line.startswith("body_parts:"), F.regexp_replace("line", "^body_parts:", "")).when(line.rlike(r"^#body_parts\s"), F.regexp_replace("line", r"^#body_parts\s+", "")).when(line.rlike(r"\tinfo\tbody_parts\t"), F.regexp_extract("line", r"\tinfo\tbody_parts\t([^\t]*)", 1))
    is_hash = line.rlike(r"^#(?:columns|version|session_start|session_id|sync|zone_config_begin)\b")
    return {"columns": named, "parts": parts, "hash": is_hash, "bmv": line.rlike(r"^[BMV] [\[{]"), "json": line.rlike(r'^\s*\{.*"')}


_SAID = "columns IS NOT NULL OR parts IS NOT NULL OR hash OR bmv OR json"


def _listed(parts: Column) -> Column:
    """Body parts from their text: a JSON list, or words."""
    listed = F.coalesce(F.from_json(parts, "array<string>"), F.transform(F.split(parts, r"[,\s]+"), F.trim))
    return F.filter(listed, lambda p: p != "")


def _layout(rows: DataFrame) -> DataFrame:
    """file, dialect, columns as the file names them, body_parts: one row per file."""
    marks = rows.select("file", "at", *(v.alias(k) for k, v in _marks().items())).where(_SAID)
    of = marks.groupBy("file").agg(F.min_by("columns", F.when(F.col("columns").isNotNull(), F.col("at"))).alias("columns"), F.max("parts").alias("parts"), *(F.max(c).alias(c) for c in ("hash", "bmv", "json")))
    kind = F.when(F.col("bmv"), "bmv").when(F.col("hash"), "hash").when(F.col("columns").isNotNull(), "columns").when(F.col("json"), "json").otherwise("plain")
    return of.select("file", kind.alias("dialect"), F.coalesce("columns", F.array(*map(F.lit, BASE_COLUMNS))).alias("columns"), _listed(F.col("parts")).alias("body_parts"))


def _named(columns: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Canonical names of the columns that have one, else their own."""
    known = F.create_map(*(F.lit(x) for name, others in aliases.items() for o in others for x in (o, name)))
    own = lambda c: F.lower(F.trim(c))
    return F.transform(columns, lambda c: F.coalesce(F.try_element_at(known, own(c)), own(c)))


def _places(names: Column) -> Column:
    """at_ and each canonical name: the place of its column, of two of one name the later one; others: name and place of each column without a canonical name."""
    place = lambda n: (F.size(names) - F.nullif(F.array_position(F.reverse(names), n), F.lit(0))).cast("int")
    others = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("i"))), lambda e: ~e["name"].isin(*CANONICAL) & (place(e["name"]) == e["i"]))
    return F.struct(others.alias("others"), *(place(n).alias(f"at_{n}") for n in CANONICAL))


def _laid_out(rows: DataFrame) -> DataFrame:
    """file, at, line of the frames among ``_marked_lines``, with what their file's layout says: json_frames (whether it may have JSON frames), places (null if it names no columns), parts.

    A file's lines meet in one window, where its frames are numbered later, so files are read once and no layout is joined to its lines.
    """
    marks = {k: F.when(F.col("mark"), v) for k, v in _marks().items()}
    d = rows.withColumns({"frame": is_frame(F.col("line")), **marks})
    d = d.withColumns({f"{k}_names": _named(F.col("columns"), t) for k, t in (("hash", HASH_ALIASES), ("columns", ALIASES))})
    named = F.when(F.col("columns").isNotNull(), F.struct(*(_places(F.col(f"{k}_names")).alias(k) for k in ("hash", "columns"))))
    d = d.select("file", "at", F.when(F.col("frame"), F.col("line")).alias("line"), "frame", "parts", "hash", "bmv", "json", named.alias("named"), F.expr(_SAID).alias("said"))
    whole = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = {"named": F.first("named", ignorenulls=True).over(whole), **{c: F.max(c).over(whole) for c in ("parts", "hash", "bmv", "json", "said")}}
    d = d.withColumns(of).where("frame")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    json_frames = ~yes("said") | yes("bmv") | (~yes("hash") & F.col("named").isNull() & yes("json"))
    places = F.when(yes("hash") & ~yes("bmv"), F.col("named.hash")).otherwise(F.col("named.columns"))
    return d.select("file", "at", "line", json_frames.alias("json_frames"), places.alias("places"), "parts")


def dialect(rows: DataFrame) -> DataFrame:
    """file, dialect of every file that has a line."""
    files = rows.select("file").distinct().join(_layout(rows), "file", "left")
    return files.select("file", F.coalesce("dialect", F.lit("plain")).alias("dialect"))


def pose_of(cell: Column, parts: Column) -> Column:
    """A pose cell as part -> x, y, conf: named points, or points in the order of parts, of the first animal if there are several.

    Points beyond the named parts, and parts without a point of two numbers, are left out; points without names are no pose.
    """
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"), F.get(p, 2).alias("conf"))
    named = F.map_filter(F.from_json(cell, "map<string,array<double>>"), lambda _, p: F.size(p) >= 2)
    points = F.when(cell.rlike(r"^\s*\[\s*\[\s*\["), F.get(F.from_json(cell, "array<array<array<double>>>"), 0)).otherwise(F.from_json(cell, "array<array<double>>"))
    pairs = F.filter(F.zip_with(parts, points, lambda n, p: F.struct(n.alias("key"), p.alias("value"))), lambda e: e["key"].isNotNull() & (F.size(e["value"]) >= 2))
    placed = F.map_from_entries(pairs)
    return F.transform_values(F.when(cell.rlike(r"^\s*\{"), named).when(cell.rlike(r"^\s*\["), placed), lambda _, p: point(p))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of session files of every dialect by canonical names; columns are found by name, never by place.

    session (the file), segment (a frame counter that falls starts the next), frame_number, frame_ts_ms, pose_ts_ms, mcu_ts_ms,
    capture_host_ns, speed, location, pose, stage, tracker_off (the pose cell is ``na``, other than ``none``), row_index, other (columns without a
    canonical name). A clock cell that doesn't parse is the row's index. Of two columns of one name the later one counts.
    """
    w = Window.partitionBy("file").orderBy("at")
    d = _laid_out(_marked_lines(spark, path))
    plain = {n: F.lit(BASE_COLUMNS.index(n)) if n in BASE_COLUMNS else F.lit(None).cast("int") for n in CANONICAL}
    # an object's text is told by its first character and cells by a tab, for whatever a filter asks is computed for it once more
    is_json = F.col("line").rlike(r"^\s*\{")
    d = d.where((is_json & F.col("json_frames")) | (~is_json & F.contains("line", F.lit("\t"))))
    d = d.withColumns({"cells": F.split("line", "\t"), "json": F.from_json(F.when(is_json, F.col("line")), "struct<" + ",".join(f"{f}:string" for f in dict.fromkeys(x for fs in _JSON.values() for x in fs)) + ">")})
    tabular = {n: F.get("cells", F.when(F.col("places").isNull(), plain[n]).otherwise(F.col(f"places.at_{n}"))) for n in CANONICAL}
    jsonic = {n: F.coalesce(*(F.col(f"json.{f}") for f in _JSON[n])) if n in _JSON else F.lit(None).cast("string") for n in CANONICAL}
    d = d.withColumns({f"c_{n}": F.when(F.col("json").isNotNull(), jsonic[n]).otherwise(tabular[n]) for n in CANONICAL})
    d = d.withColumn("row_index", F.row_number().over(w).cast("long") - 1)
    d = d.withColumn("frame_number", F.coalesce(number(F.col("c_frame_number")).cast("long"), F.when(F.col("json").isNotNull(), F.col("row_index"))))
    d = d.withColumn("segment", F.sum(F.coalesce((F.col("frame_number") < F.lag("frame_number").over(w)).cast("int"), F.lit(0))).over(w))
    text = lambda c: F.when(~is_absent(F.col(c)), F.col(c))
    # points without names are named by their place, as many as a cell can have
    points = F.greatest(F.length("c_pose_array") - F.length(F.replace("c_pose_array", F.lit("["), F.lit(""))), F.lit(1))
    numbered = F.transform(F.sequence(F.lit(0), points), lambda i: i.cast("string"))
    return d.select(
        F.col("file").alias("session"),
        "segment",
        "frame_number",
        F.coalesce(elapsed_ms(F.col("c_frame_ts_ms")), F.col("row_index").cast("double")).alias("frame_ts_ms"),
        elapsed_ms(F.col("c_pose_ts_ms")).alias("pose_ts_ms"),
        elapsed_ms(F.col("c_mcu_ts_ms")).alias("mcu_ts_ms"),
        text("c_capture_host_ns").try_cast("long").alias("capture_host_ns"),
        number(F.col("c_speed")).alias("speed"),
        text("c_location").alias("location"),
        pose_of(text("c_pose_array"), F.coalesce(F.nullif(_listed(F.col("parts")), F.array().cast("array<string>")), numbered)).alias("pose"),
        F.nullif(last_state(text("c_stage")), F.lit("")).alias("stage"),
        F.coalesce(F.lower(F.trim("c_pose_array")) == "na", F.lit(False)).alias("tracker_off"),
        "row_index",
        F.map_from_entries(F.transform(F.coalesce("places.others", F.array().cast("array<struct<name:string,i:int>>")), lambda e: F.struct(e["name"], F.get("cells", e["i"])))).alias("other"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """session, t_s, type, subtype, content of the event rows of session files; ``info`` rows at time 0 are header, not events."""
    rows = lines(spark, path)
    d = rows.where(~F.col("line").rlike("^(?:#|Zones|[BMV] )")).select(F.col("file").alias("session"), F.split("line", "\t").alias("c"))
    d = d.select("session", number(F.get("c", 0)).alias("t_s"), F.lower(F.trim(F.get("c", 1))).alias("type"), F.coalesce(F.get("c", 2), F.lit("")).alias("subtype"), F.coalesce(F.get("c", 3), F.lit("")).alias("content"))
    return d.where(F.col("type").isin(*EVENT_WORDS) & ~F.coalesce((F.col("type") == "info") & (F.col("t_s") == 0), F.lit(False)))


def frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """session, frames: how many frames each file holds; no cell is parsed."""
    return counted(lines(spark, path))


def counted(rows: DataFrame) -> DataFrame:
    """``frame_counts`` of lines as ``lines`` gives them."""
    found = rows.where(is_frame(F.col("line"))).join(_layout(rows).select("file", "dialect"), "file", "left")
    found = found.where("line NOT LIKE '{%' OR coalesce(dialect, 'json') IN ('json', 'bmv')")
    return found.groupBy(F.col("file").alias("session")).agg(F.count("*").alias("frames"))


def first_point(frames: DataFrame, part: str | None = None) -> DataFrame:
    """frames with x, y of the named part, or of the pose's first one."""
    p = F.try_element_at("pose", F.lit(part)) if part else F.get(F.map_values("pose"), 0)
    return frames.withColumns({"x": p["x"], "y": p["y"]})


def read_event_log(spark: SparkSession, path: str, files: str = "*.tsv") -> DataFrame:
    """session, t_ms, type, subtype, content of controller logs: four tab-separated fields, seconds first; malformed lines are left out."""
    t = _text(spark, path, files).select(F.col("file").alias("session"), F.split("line", "\t").alias("c"))
    t = t.where((F.size("c") >= 4) & F.get("c", 0).try_cast("double").isNotNull())
    return t.select("session", F.round(F.get("c", 0).try_cast("double") * 1000).cast("long").alias("t_ms"), F.get("c", 1).alias("type"), F.get("c", 2).alias("subtype"), F.get("c", 3).alias("content"))


def state_timeline(log: DataFrame) -> DataFrame:
    return log.where("type = 'state'").select("session", "t_ms", F.col("content").alias("state"))


def state_events(frames: DataFrame) -> DataFrame:
    """session, t_ms, name: the states that a recording's frames turn to, for files that don't log them; a frame without a state changes nothing."""
    before = F.last("stage", ignorenulls=True).over(Window.partitionBy("session").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1))
    turned = F.col("stage").isNotNull() & ~F.col("stage").eqNullSafe(F.col("before"))
    return frames.withColumn("before", before).where(turned).select("session", F.col("frame_ts_ms").alias("t_ms"), F.col("stage").alias("name"))


def exploded_states(frames: DataFrame, column: str = "stage") -> DataFrame:
    """One row per bar-joined state of a frame, ``-`` and absent ones left out."""
    e = frames.select("*", F.posexplode(F.split(column, "\\|")).alias("ord", "one"))
    return e.where(~is_absent(F.col("one")) & (F.col("one") != "-")).drop(column).withColumnRenamed("one", column)


def keypoints(frames: DataFrame) -> DataFrame:
    """session, frame, part, x, y, conf: a row per located point."""
    return frames.select("session", F.col("frame_number").alias("frame"), F.explode("pose").alias("part", "p")).select("session", "frame", "part", "p.x", "p.y", F.coalesce("p.conf", F.lit(1.0)).alias("conf"))


def read_runs(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """Rows of run-history files, be they an array, one object, or an envelope with ``runs``."""
    item = "struct<subject:string,box:string,date:string,started:string,data_file:string,video_file:string>"
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path, wholetext=True)
    as_list = F.from_json("value", f"array<{item}>")
    envelope = F.from_json("value", f"struct<runs:array<{item}>>")["runs"]
    single = F.array(F.from_json("value", item))
    runs = F.when(F.col("value").rlike(r"^\s*\["), as_list).when(envelope.isNotNull(), envelope).otherwise(single)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.explode(runs).alias("r")).select("file", "r.*")


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """A cohort sheet (CSV with a header). Subject and SetupID must be there."""
    sheet = spark.read.option("header", "true").csv(path)
    if missing := {"Subject", "SetupID"} - set(sheet.columns):
        raise ValueError(f"cohort sheet lacks {', '.join(sorted(missing))}")
    return sheet.where(~is_absent(F.col("Subject")))


def _folder(session: Column) -> Column:
    """The folder's name as Spark's partitioned writers have it: what a path can't hold is escaped."""
    text = F.nullif(session.cast("string"), F.lit(""))
    odd = F.regexp_count(text, F.lit(_ODD)) > 0
    hexed = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_ODD), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.concat(F.lit("session="), F.coalesce(F.when(odd, F.array_join(hexed, "")).otherwise(text), F.lit("__HIVE_DEFAULT_PARTITION__")))


def write_lines(lines_of: DataFrame, path: str) -> None:
    """Lines (session, ord, value) as one text file per session, in order, each in the folder ``session=...`` of its own. Nothing that lines_of reads may lie below path."""
    # dealt by a hash of the session: an exchange by the session itself is left out over a union whose parts are dealt so already, and then parts are coalesced each by itself
    out = lines_of.repartition(F.xxhash64("session")).sortWithinPartitions("session", "ord")
    from burrow.sources import session_source

    if not session_source.can_write(path):
        out.select("session", "value").write.mode("overwrite").partitionBy("session").text(path)
        return
    lines_of.sparkSession.dataSource.register(session_source.SessionFiles)
    out.select(_folder(F.col("session")).alias("folder"), F.col("value").cast("string")).write.format("session_files").mode("overwrite").save(path)


def session_of(file: Column) -> Column:
    """The session in whose folder a file is, as ``write_lines`` and ``write_frames`` make them."""
    return F.url_decode(F.regexp_extract(file, r"/session=([^/]*)/", 1))


def write_frames(frames: DataFrame, path: str, columns: list[str]) -> None:
    """Frames as tab-separated text, one folder per session: absent strings ``na``, absent numbers ``none``, 4 decimals, columns named first."""
    kinds = dict(frames.dtypes)

    def cell(c: str):
        if kinds[c] == "double":
            return F.when(F.col(c).isNull() | F.isnan(c), F.lit("none")).otherwise(F.format_string("%.4f", c))
        if c == "pose":  # named points as lists
            return F.coalesce(F.to_json(F.transform_values(c, lambda _, p: F.array(p["x"], p["y"], p["conf"]))), F.lit("none"))
        if kinds[c].startswith(("map", "array", "struct")):
            return F.coalesce(F.to_json(c), F.lit("na"))
        return F.coalesce(escaped(F.col(c).cast("string")), F.lit("na"))

    body = frames.select("session", F.col("frame_number").alias("ord"), F.concat_ws("\t", *(cell(c) for c in columns)).alias("value"))
    head = frames.select("session").distinct().select("session", F.lit(-1).cast("long").alias("ord"), F.lit("# " + "\t".join(columns)).alias("value"))
    named = head.unionByName(body)
    write_lines(named.withColumn("session", F.when(F.contains(F.col("session").cast("string"), F.lit("/")), F.sha2(F.col("session").cast("string"), 256)).otherwise(F.col("session").cast("string"))), path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, modified, digest (first 16 hex digits of SHA-256) of every input below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def stale(inputs: DataFrame, stamps: DataFrame, stages: list[str]) -> DataFrame:
    """file, stage of what must run again: stages whose input digest differs from the stamp, and all after them."""
    wanted = inputs.select("file", "digest", F.posexplode(F.array(*(F.lit(s) for s in stages))).alias("ord", "stage"))
    j = wanted.join(stamps.select("file", "stage", F.col("digest").alias("done")), ["file", "stage"], "left").withColumn("fresh", F.coalesce(F.col("done") == F.col("digest"), F.lit(False)))
    first = F.min(F.when(~F.col("fresh"), F.col("ord"))).over(Window.partitionBy("file"))
    return j.withColumn("from_ord", first).where(F.col("ord") >= F.col("from_ord")).select("file", "stage")


def badges(runs: DataFrame, files: DataFrame) -> DataFrame:
    """file, badge: OK, MISSING (listed only), MODIFIED (digests differ) or UNLISTED (found only)."""
    j = runs.select("file", F.col("digest").alias("listed")).join(files.select("file", F.col("digest").alias("found")), "file", "full")
    badge = F.when(F.col("found").isNull(), "MISSING").when(F.col("listed").isNull(), "UNLISTED").when(F.col("listed") != F.col("found"), "MODIFIED").otherwise("OK")
    return j.select("file", badge.alias("badge"))
