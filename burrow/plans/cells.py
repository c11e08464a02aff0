"""Queries of parsing rules, exploded states, logs, badges and changes of zone sets: operators that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import scalars
from burrow.operators import live
from burrow.plans import files
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.scratch import scratch
from burrow.sources import sessions

_HASH = "printf('%08x', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h*33 + c) % 4294967296))"


@query("text_hashes", f"SELECT p_partkey AS id, {_HASH.format('p_name')} AS name_hash, {_HASH.format('p_type')} AS type_hash FROM part")
def text_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.text_hash(F.col("p_name")).alias("name_hash"), scalars.text_hash(F.col("p_type")).alias("type_hash"))


@query("second_clocks", """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS k, CASE l_partkey % 5 WHEN 0 THEN 'na' WHEN 1 THEN (l_partkey % 100) || '.25' WHEN 2 THEN (l_partkey % 70) || ':0' || (l_partkey % 10) || '.5' WHEN 3 THEN 'x' || l_partkey ELSE (l_partkey % 9)::VARCHAR END AS cell FROM lineitem)
SELECT id, line, CASE k % 5 WHEN 1 THEN (k % 100)*1000 + 250.0 WHEN 2 THEN (k % 70)*60000 + (k % 10)*1000 + 500.0 WHEN 4 THEN (k % 9)*1000.0 END::DOUBLE AS ms FROM c""")
def second_clocks(spark, sf_dir):
    """The dialect in which a bare number is seconds."""
    k = F.col("l_partkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    cell = F.when(k % 5 == 0, "na").when(k % 5 == 1, text(k % 100, ".25")).when(k % 5 == 2, text(k % 70, ":0", k % 10, ".5")).when(k % 5 == 3, text("x", k)).otherwise(text(k % 9))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), scalars.elapsed_s(cell).alias("ms"))


@query("safe_cells", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS number, replace(p_type, ' ', CASE p_partkey % 4 WHEN 0 THEN '\\t' WHEN 1 THEN '\\n' WHEN 2 THEN '\\r' ELSE ' ' END) AS cell, regexp_replace(p_name, '[ _-]?([0-9]+|[A-Za-z])$', '') AS stem FROM part""")
def safe_cells(spark, sf_dir):
    """Numbers without NaN and infinities, cells without control characters, names without their number."""
    k = F.col("p_partkey")
    number = F.when(k % 3 == 0, F.col("p_retailprice")).when(k % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    mark = F.when(k % 4 == 0, "\t").when(k % 4 == 1, "\n").when(k % 4 == 2, "\r").otherwise(" ")
    return table(spark, sf_dir, "part").select(k.alias("id"), scalars.json_safe(number).alias("number"), scalars.escaped(F.replace("p_type", F.lit(" "), mark)).alias("cell"), scalars.numbered_stem(F.col("p_name")).alias("stem"))


@query("exploded_states", f"""WITH {FRAMES}, s AS (SELECT session, frame, CASE WHEN k % 4 = 0 THEN '-' WHEN k % 4 = 1 THEN zone || '|' || k WHEN k % 4 = 2 THEN 'na|' || zone ELSE zone END AS st FROM d),
e AS (SELECT session, frame, unnest(string_split(st, '|')) AS state, generate_subscripts(string_split(st, '|'), 1) - 1 AS ord FROM s) SELECT session, frame, ord::INT AS ord, state FROM e WHERE state NOT IN ('-', 'na')""")
def exploded_states(spark, sf_dir):
    """A row for each of a frame's states."""
    k, z = F.col("k"), F.col("zone")
    cell = F.when(k % 4 == 0, "-").when(k % 4 == 1, F.concat(z, F.lit("|"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("na|"), z)).otherwise(z)
    f = frames(spark, sf_dir).select("session", "frame", cell.alias("stage"))
    return sessions.exploded_states(f).select("session", "frame", "ord", F.col("stage").alias("state"))


@query("parted_keypoints", f"WITH {files._E} SELECT session, frame, part, CASE part WHEN 'nose' THEN round(speed, 2) ELSE 1.5 END AS x, CASE part WHEN 'nose' THEN k ELSE 2.5 END::DOUBLE AS y, CASE part WHEN 'nose' THEN 0.9 ELSE 0.8 END::DOUBLE AS conf FROM e, (VALUES ('nose'), ('tail')) p(part) WHERE k % 4 > 1")
def parted_keypoints(spark, sf_dir):
    """A row per located point of session files."""
    d = sessions.keypoints(sessions.read_frames(spark, files._hash(spark, sf_dir)))
    return d.withColumn("session", sessions.session_of(F.col("session")).cast("long"))


@query("state_log", f"WITH {files._E} SELECT session, ms AS t_ms, zone AS state FROM e WHERE k % 3 = 0")
def state_log(spark, sf_dir):
    """State rows of controller logs, among prints and broken lines."""
    e, path = files._events(spark, sf_dir), scratch(spark, "states")
    kind = F.when(F.col("k") % 3 == 0, "state").otherwise("print")
    line = F.when(F.col("k") % 3 == 2, "broken line").otherwise(F.concat_ws("\t", F.format_string("%.3f", F.col("ms") / 1000), kind, F.lit(""), F.col("zone")))
    sessions.write_lines(e.select("session", F.col("frame").alias("ord"), line.alias("value")), path)
    d = sessions.state_timeline(sessions.read_event_log(spark, path, "*.txt"))
    return d.withColumn("session", sessions.session_of(F.col("session")).cast("long"))


@query("file_badges", """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT 'f' || k AS file, CASE k % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'MODIFIED' ELSE 'UNLISTED' END AS badge FROM c""")
def file_badges(spark, sf_dir):
    """Listed and found files with their digests."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), k).alias("file"), k, F.sha1(F.col("c_name")).alias("digest"))
    found = c.where(k % 4 != 1).withColumn("digest", F.when(k % 4 == 2, F.reverse("digest")).otherwise(F.col("digest")))
    return sessions.badges(c.where(k % 4 != 3), found)


@query("zone_set_changes", f"""WITH {FRAMES}, s AS (SELECT session, frame, CASE WHEN k % 4 = 0 THEN ['a'] WHEN k % 4 = 1 THEN [] ELSE list_sort(list_distinct(['a', zone])) END AS z FROM d), l AS (SELECT *, lag(z) OVER (PARTITION BY session ORDER BY frame) AS b FROM s)
SELECT session, frame, array_to_string(list_sort(list_filter(z, lambda x: NOT list_contains(b, x))), '|') AS entered, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(z, x))), '|') AS gone FROM l WHERE b IS NOT NULL AND b <> z""")
def zone_set_changes(spark, sf_dir):
    """Which zones of overlapping ones a frame enters and leaves; a session's first set is only the baseline."""
    k = F.col("k")
    now = F.when(k % 4 == 0, F.array(F.lit("a"))).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), "zone"))
    return live.set_changes(frames(spark, sf_dir).select("session", "frame", now.alias("zones")), "zones")
