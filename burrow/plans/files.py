"""Queries through files: each writes the events as session files of one dialect into the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions.scalars import format_elapsed
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.scratch import scratch
from burrow.sources import session_source, sessions, zone_files

_E = f"{FRAMES}, e AS (SELECT *, t_us // 1000 - min(t_us // 1000) OVER (PARTITION BY session) AS ms FROM d)"


def _events(spark, sf_dir):
    from pyspark.sql import Window

    ms = F.floor(F.col("t_us") / 1000)
    return frames(spark, sf_dir).withColumn("ms", ms - F.min(ms).over(Window.partitionBy("session")))


def _files(spark, events, name: str, head: list, row, more=None) -> str:
    """Header lines (strings or Columns over a session's row) and one line per event."""
    path = scratch(spark, name)
    one = events.select("session").distinct()
    lines = events.select("session", F.col("frame").alias("ord"), row.alias("value"))
    told = F.array(*(F.struct(F.lit(i - len(head)).cast("long").alias("ord"), (F.lit(h) if isinstance(h, str) else h).alias("value")) for i, h in enumerate(head)))
    lines = lines.unionByName(one.select("session", F.inline(told)))
    sessions.write_lines(lines if more is None else lines.unionByName(more), path)
    return path


def _hash(spark, sf_dir):
    cell = lambda c: F.col(c).cast("string")
    pose = F.when(F.col("k") % 4 == 0, "na").when(F.col("k") % 4 == 1, "none").otherwise(F.format_string("[[%.2f,%d,0.9],[1.5,2.5,0.8]]", "speed", "k"))
    state = F.when(F.col("k") < 30, "-").otherwise(F.concat(F.lit("x|"), F.col("zone")))
    row = F.concat_ws("\t", cell("frame"), format_elapsed(F.col("ms")), (F.col("t_us") * 1000).cast("string"), F.when(F.col("k") > 90, "na").otherwise(cell("k")), pose, F.when(F.col("k") < 50, F.col("zone")).otherwise("na"), state, F.format_string("%.2f", "speed"), F.lit("q"))
    head = ["#version   3", F.concat(F.lit("#session_start     start-"), F.col("session")), "#zone_config_begin", "{", '"scale": {}, "zones": {', F.format_string('"A": {"type": "polygon", "points": [[0, 0], [%d, 0], [0, 9]]}}', "session"), "}", "#zone_config_end", '#body_parts ["nose","tail"]', "#columns frame elapsed capture_host_ns frame_fw_ms pose zone state speed extra"]
    return _files(spark, _events(spark, sf_dir), "hash", head, row)


def _columns(spark, sf_dir):
    e = _events(spark, sf_dir)
    pose = F.when(F.col("k") % 4 == 0, "na").when(F.col("k") % 4 == 1, "none").otherwise(F.format_string('{"nose":[%.2f,%d,0.9],"tail":[1.5,2.5,0.8]}', "speed", "k"))
    row = F.concat_ws("\t", F.col("frame").cast("string"), F.lit("77"), F.col("ms").cast("string"), F.format_string("%.2f", "speed"), F.when(F.col("k") < 50, F.col("zone")).otherwise("none"), pose, F.when(F.col("k") < 30, "-").otherwise(F.col("zone")))
    head = ["time\ttype\tsubtype\tcontent", F.concat(F.lit("0.000\tinfo\tsubject_id\tm"), F.col("session")), '0.000\tinfo\tbody_parts\t["nose","tail"]', F.format_string('Zones\t[{"name":"A","type":"polygon","points":[[0,0],[%d,0],[0,9]]},{"name":"nil"}]', "session"), "# frame_number\tcam_frame_id\tactual_ts\tspeed\tlocation\tpose_array\tstage"]
    told = e.where("k > 80").select("session", F.col("frame").alias("ord"), F.concat_ws("\t", F.format_string("%.3f", F.col("ms") / 1000), F.lit("print"), F.lit("task"), F.col("zone")).alias("value"))
    return _files(spark, e, "columns", head, row, told)


def _objects(spark, sf_dir):
    pose = F.when(F.col("k") % 4 > 1, F.array(F.array(F.round("speed", 2), F.col("k").cast("double"), F.lit(0.9)), F.array(F.lit(1.5), F.lit(2.5), F.lit(0.8))))
    row = F.to_json(F.struct(F.col("frame").alias("frames"), F.col("k").alias("mcu_frame"), F.when(F.col("k") >= 30, F.concat(F.lit("State: "), F.col("zone"))).alias("state_name"), F.col("ms").alias("timestamps"), F.round("speed", 2).alias("speed"), F.when(F.col("k") < 50, F.col("zone")).alias("location"), pose.alias("pose_array")))
    head = [F.format_string('B {"Subject ID": "m%d", "fps": 30}', "session"), F.format_string('M {"zones": {"A": {"type": "polygon", "values": [[0, 0], [%d, 0], [0, 9]], "points": null}}}', "session"), "V [8, 390, 16, 512]"]
    return _files(spark, _events(spark, sf_dir), "objects", head, row)


def _read(spark, path):
    f = sessions.read_frames(spark, path)
    nose = F.coalesce(F.try_element_at("pose", F.lit("nose")), F.try_element_at("pose", F.lit("0")))
    return f.select(sessions.session_of(F.col("session")).cast("long").alias("session"), "segment", "row_index", "frame_number", "frame_ts_ms", "mcu_ts_ms", "capture_host_ns", "speed", "location", "stage", "tracker_off", nose["x"].alias("x"), nose["y"].alias("y"), F.map_concat("other").alias("other"))


_COMMON = "session, 0::BIGINT AS segment, row_number() OVER (PARTITION BY session ORDER BY frame) - 1 AS row_index, frame AS frame_number, ms::DOUBLE AS frame_ts_ms, round(speed, 2) AS speed, CASE WHEN k < 50 THEN zone END AS location, CASE WHEN k >= 30 THEN zone END AS stage, CASE WHEN k % 4 > 1 THEN round(speed, 2) END AS x, CASE WHEN k % 4 > 1 THEN k::DOUBLE END AS y"


@query("hash_sessions", f"WITH {_E} SELECT {_COMMON}, CASE WHEN k <= 90 THEN k::DOUBLE END AS mcu_ts_ms, t_us * 1000 AS capture_host_ns, k % 4 = 0 AS tracker_off, 'q' AS extra FROM e")
def hash_sessions(spark, sf_dir):
    return _read(spark, _hash(spark, sf_dir)).withColumn("extra", F.try_element_at("other", F.lit("extra"))).drop("other")


@query("column_sessions", f"WITH {_E} SELECT {_COMMON}, k % 4 = 0 AS tracker_off, '77' AS camera FROM e")
def column_sessions(spark, sf_dir):
    return _read(spark, _columns(spark, sf_dir)).withColumn("camera", F.try_element_at("other", F.lit("cam_frame_id"))).drop("other", "mcu_ts_ms", "capture_host_ns")


@query("object_sessions", f"WITH {_E} SELECT {_COMMON}, false AS tracker_off FROM e")
def object_sessions(spark, sf_dir):
    return _read(spark, _objects(spark, sf_dir)).drop("other", "mcu_ts_ms", "capture_host_ns")


@query("session_events", f"WITH {_E} SELECT session, round(ms / 1000.0, 3) AS t_s, 'print' AS type, 'task' AS subtype, zone AS content FROM e WHERE k > 80")
def session_events(spark, sf_dir):
    e = sessions.read_events(spark, _columns(spark, sf_dir))
    return e.withColumn("session", sessions.session_of(F.col("session")).cast("long"))


@query("session_frame_counts", f"WITH {_E} SELECT dialect, session, count(*) AS frames FROM e, (VALUES ('bmv'), ('columns'), ('hash')) v(dialect) GROUP BY ALL")
def session_frame_counts(spark, sf_dir):
    found = None
    for path in (_hash(spark, sf_dir), _columns(spark, sf_dir), _objects(spark, sf_dir)):
        rows = sessions.lines(spark, path)
        kinds = sessions.dialect(rows).withColumnRenamed("file", "session")
        one = sessions.counted(rows).join(kinds, "session").select("dialect", sessions.session_of(F.col("session")).cast("long").alias("session"), "frames")
        found = one if found is None else found.unionByName(one)
    return found


@query("session_headers", f"WITH {FRAMES} SELECT DISTINCT kind, session, CASE kind WHEN 'hash' THEN 'start-' || session WHEN 'columns' THEN 'm' || session ELSE 'm' || session || '/30/[8, 390, 16, 512]' END AS told FROM f, (VALUES ('hash'), ('columns'), ('objects')) v(kind)")
def session_headers(spark, sf_dir):
    found = None
    for kind, path, keys in (("hash", _hash(spark, sf_dir), ["start_time"]), ("columns", _columns(spark, sf_dir), ["subject_id"]), ("objects", _objects(spark, sf_dir), ["Subject ID", "target_fps", "crop"])):
        h = sessions.headers(sessions.lines(spark, path))
        one = h.select(F.lit(kind).alias("kind"), sessions.session_of(F.col("file")).cast("long").alias("session"), F.concat_ws("/", *(F.try_element_at("header", F.lit(k)) for k in keys)).alias("told"))
        found = one if found is None else found.unionByName(one)
    return found


@query("session_zones", f"WITH {FRAMES} SELECT DISTINCT kind, session, 'A' AS name, session::DOUBLE AS x1 FROM f, (VALUES ('hash'), ('columns'), ('objects')) v(kind)")
def session_zones(spark, sf_dir):
    found = None
    for kind, path in (("hash", _hash(spark, sf_dir)), ("columns", _columns(spark, sf_dir)), ("objects", _objects(spark, sf_dir))):
        z = zone_files.zones_of(sessions.zone_text(sessions.lines(spark, path)))
        one = z.select(F.lit(kind).alias("kind"), sessions.session_of(F.col("file")).cast("long").alias("session"), "name", F.get(F.get("points", 1), 0).alias("x1"))
        found = one if found is None else found.unionByName(one)
    return found


@query("written_frames", f"WITH {_E} SELECT session, frame AS frame_number, ms::DOUBLE AS frame_ts_ms, round(speed, 4) AS speed, CASE WHEN k < 50 THEN zone END AS location FROM e")
def written_frames(spark, sf_dir):
    e = _events(spark, sf_dir)
    path = scratch(spark, "frames")
    rows = e.select("session", F.col("frame").alias("frame_number"), F.col("frame").alias("frame"), format_elapsed(F.col("ms")).alias("elapsed"), "speed", F.when(F.col("k") < 50, F.col("zone")).alias("location"))
    sessions.write_frames(rows, path, ["frame", "elapsed", "speed", "location"])
    f = sessions.read_frames(spark, path)
    return f.select(sessions.session_of(F.col("session")).cast("long").alias("session"), "frame_number", "frame_ts_ms", "speed", "location")


@query("controller_log", f"WITH {_E} SELECT session, ms AS t_ms, 'state' AS type, '' AS subtype, zone AS content FROM e WHERE k >= 40")
def controller_log(spark, sf_dir):
    e = _events(spark, sf_dir).where("k >= 40")
    row = F.concat_ws("\t", F.format_string("%.3f", F.col("ms") / 1000), F.lit("state"), F.lit(""), F.col("zone"))
    path = _files(spark, e, "log", ["time\ttype\tsubtype\tcontent", "broken line"], row)
    log = sessions.read_event_log(spark, path, "*.txt")
    return log.withColumn("session", sessions.session_of(F.col("session")).cast("long"))


@query("run_histories", "SELECT c_custkey::VARCHAR AS subject, c_mktsegment AS box FROM customer")
def run_histories(spark, sf_dir):
    """A file per nation: an array of runs, or an envelope around it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("session"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("box"))
    c = c.join(c.groupBy("session").agg(F.min("ord").alias("first")), "session")
    item = F.to_json(F.struct(F.col("ord").cast("string").alias("subject"), "box"))
    items = c.select("session", "ord", F.when(F.col("ord") == F.col("first"), item).otherwise(F.concat(F.lit(","), item)).alias("value"))
    odd = F.col("session") % 2 == 1
    edges = [c.select("session").distinct().select("session", F.lit(at).cast("long").alias("ord"), F.when(odd, wrapped).otherwise(bare).alias("value")) for at, wrapped, bare in ((-1, '{"runs": [', "["), ((1 << 62), "]}", "]"))]
    path = scratch(spark, "runs")
    sessions.write_lines(items.unionByName(edges[0]).unionByName(edges[1]), path)
    return sessions.read_runs(spark, path, "*.txt").select("subject", "box")


@query("cohort_sheet", "SELECT c_custkey::VARCHAR AS Subject, c_nationkey::VARCHAR AS SetupID FROM customer WHERE c_custkey % 5 <> 0")
def cohort_sheet(spark, sf_dir):
    path = scratch(spark, "cohort")
    c = table(spark, sf_dir, "customer")
    c.select(F.when(F.col("c_custkey") % 5 == 0, "na").otherwise(F.col("c_custkey").cast("string")).alias("Subject"), F.col("c_nationkey").alias("SetupID")).write.option("header", "true").csv(path)
    return sessions.read_cohort(spark, path).select("Subject", "SetupID")


@query("listed_headers", f"WITH {FRAMES} SELECT DISTINCT session, 'start-' || session AS started, true AS few FROM f")
def listed_headers(spark, sf_dir):
    """Headers from the first blocks of each file, and whether that was little of it."""
    d = session_source.listed(spark, _hash(spark, sf_dir))
    return d.select(sessions.session_of(F.col("file")).cast("long").alias("session"), F.col("header")["start_time"].alias("started"), (F.col("bytes_read") <= 2 * session_source.BLOCK).alias("few"))


@query("scanned_columns", f"WITH {_E} SELECT session, frame AS frame_number, round(speed, 2) AS speed, CASE WHEN k < 50 THEN zone END AS location FROM e")
def scanned_columns(spark, sf_dir):
    """Three columns of session files; no other cell is kept."""
    d = session_source.scan(spark, _hash(spark, sf_dir), ["frame_number", "speed", "location"])
    return d.select(sessions.session_of(F.col("session")).cast("long").alias("session"), "frame_number", "speed", "location")


@query("state_turns", f"""WITH {_E}, s AS (SELECT session, frame, ms, CASE WHEN k >= 30 THEN zone END AS st FROM e), l AS (SELECT *, lag(st) OVER (PARTITION BY session ORDER BY frame) AS was FROM s WHERE st IS NOT NULL)
SELECT session, ms::DOUBLE AS t_ms, st AS name FROM l WHERE was IS NULL OR was <> st""")
def state_turns(spark, sf_dir):
    d = sessions.state_events(sessions.read_frames(spark, _objects(spark, sf_dir)))
    return d.withColumn("session", sessions.session_of(F.col("session")).cast("long"))


@query("pose_streams", f"""WITH {_E} SELECT session, frame AS frame_number, CASE WHEN k % 4 > 1 THEN round(speed + 1, 2) END AS x, CASE WHEN k % 4 > 1 THEN k::DOUBLE END AS y, CASE WHEN k < 50 THEN zone END AS location, 'start-' || session AS started, 'again' AS tracker FROM e""")
def pose_streams(spark, sf_dir):
    """Poses moved and written beside what the old files' headers say, then read back."""
    source, path = _hash(spark, sf_dir), scratch(spark, "poses")
    f = sessions.read_frames(spark, source).withColumn("session", F.regexp_extract("session", r"/session=([^/]*)/", 1))
    moved = f.withColumn("pose", F.transform_values("pose", lambda _, p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"), p["conf"].alias("conf"))))
    heads = session_source.head_lines(spark, source).withColumn("file", F.concat(F.regexp_extract("file", r"/session=([^/]*)/", 1), F.lit(".txt")))
    session_source.write_poses_of(heads, moved.select("session", "frame_number", "frame_ts_ms", "pose", "location"), path, ["nose", "tail"], "again")
    of = lambda c: sessions.session_of(F.col(c)).cast("long").alias("session")
    told = sessions.headers(sessions.lines(spark, path)).select(of("file"), F.col("header")["start_time"].alias("started"), F.col("header")["tracker"].alias("tracker"))
    nose = F.try_element_at("pose", F.lit("nose"))
    again = sessions.read_frames(spark, path).select(of("session"), "frame_number", F.round(nose["x"], 2).alias("x"), nose["y"].alias("y"), "location")
    return again.join(told, "session")
