"""Queries of names, headers, zone payloads, orders and plane helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import geometry, names
from burrow.operators import series
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.plans.space import zone_table
from burrow.sources import zone_files

_ENDS = ("_video_data", "_retracked", "_annotated_data", "")
_STEM = "'S' || o_custkey || '-Box' || (o_orderkey % 9) || '-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad((o_orderkey % 240000)::VARCHAR, 6, '0')"
_PATHS = f"p AS (SELECT o_orderkey AS id, {_STEM} AS stem, ['_video_data', '_retracked', '_annotated_data', ''][(o_orderkey % 4 + 1)::INT] AS tail, o_orderkey % 2 = 0 AS deep FROM orders), q AS (SELECT *, CASE WHEN deep THEN '/data/x/' ELSE '' END || stem || tail || '.txt' AS path FROM p)"


def _paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stem = F.format_string("S%d-Box%d-%s-%06d", "o_custkey", F.col("o_orderkey") % 9, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 240000)
    tail = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/data/x/").otherwise(""), stem, tail, F.lit(".txt")).alias("path"))


@query("session_stems", f"WITH {_PATHS} SELECT id, stem, CASE WHEN contains(tail, '_video_data') OR tail = '' THEN stem ELSE stem || tail END AS out_stem FROM q")
def session_stems(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", names.session_stem(F.col("path")).alias("stem"), names.output_stem(F.col("path")).alias("out_stem"))


@query("name_metadata", rf"""WITH {_PATHS}, m AS (SELECT id, stem, substr(stem, 11) AS late FROM q)
SELECT id, nullif(regexp_replace(regexp_extract(stem, '20\d\d[-_]?\d\d[-_]?\d\d'), '^(\d\d\d\d)[-_]?(\d\d)[-_]?(\d\d)$', '\1-\2-\3'), '') AS date,
CASE WHEN regexp_matches(late, '(^|[-_])\d{{6}}($|[-_])') THEN regexp_replace(regexp_extract(late, '(?:^|[-_])(\d{{6}})(?:$|[-_])', 1), '(\d\d)(\d\d)(\d\d)', '\1:\2:\3') END AS time, split_part(stem, '-', 1) AS subject FROM m""")
def name_metadata(spark, sf_dir):
    d = names.dated(names.session_stem(F.col("path")))
    return _paths(spark, sf_dir).select("id", d["date"].alias("date"), d["time"].alias("time"), d["subject"].alias("subject"))


@query("run_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def run_dates(spark, sf_dir):
    run = F.when(F.col("o_orderkey") % 3 == 0, F.lit("run7")).otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_101112_box4")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), names.run_date(run).alias("date"))


@query("header_picks", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'treated' ELSE '' END AS grp,
CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'none' END AS cage FROM customer""")
def header_picks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    header = F.create_map(F.lit("Group"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" "), F.lit("TREATMENT"), F.when(F.col("c_custkey") % 3 == 0, "treated"), F.lit("cage "), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")))
    return c.select(F.col("c_custkey").alias("id"), names.picked(header, names.IDENTITY_KEYS["Group"]).alias("grp"), names.filled(names.picked(header, names.IDENTITY_KEYS["Cage"]), F.lit("none")).alias("cage"))


@query("zone_renames", """WITH z AS (SELECT DISTINCT p_size AS session, CASE p_partkey % 5 WHEN 0 THEN 'Center' WHEN 1 THEN 'Left_arm' WHEN 2 THEN 'nose' WHEN 3 THEN 'Center_arm' ELSE 'Open' END AS name FROM part),
s AS (SELECT session, max(CASE WHEN lower(name) LIKE '%\\_arm' ESCAPE '\\' THEN 1 ELSE 0 END) = 1 AS arm FROM z GROUP BY session), n AS (SELECT z.session, name, name || CASE WHEN arm THEN '_arm' ELSE '_zone' END AS new FROM z JOIN s USING (session))
SELECT session, name, CASE WHEN name IN ('Center', 'nose') AND NOT EXISTS (SELECT 1 FROM z WHERE z.session = n.session AND z.name = n.new) THEN new ELSE name END AS analysed FROM n""".replace("\\\\", "\\"))
def zone_renames(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("Center", "Left_arm", "nose", "Center_arm", "Open"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return names.renamed_zones(p.select(F.col("p_size").alias("session"), kind.alias("name")).distinct(), ["Nose"])


@query("part_roles", """WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k FROM part) SELECT id, CASE k WHEN 0 THEN 'Snout' WHEN 1 THEN 'Head' ELSE NULL END AS head, CASE k WHEN 0 THEN 'Tail Base' WHEN 1 THEN 'Center' ELSE NULL END AS body,
CASE k WHEN 0 THEN 'Snout' WHEN 1 THEN 'Center' WHEN 2 THEN 'Left_Ear' END AS followed, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS pairs FROM p""")
def part_roles(spark, sf_dir):
    lists = (["Snout", "Tail Base", "Left_Ear"], ["Head", "Center", "l_paw", "r_paw"], ["Left_Ear", "lever", "Right_Ear", "reward", "ear-left", "Ear right"])
    k = F.col("p_partkey") % 4
    parts = F.when(k == 0, F.array(*map(F.lit, lists[0]))).when(k == 1, F.array(*map(F.lit, lists[1]))).when(k == 2, F.array(*map(F.lit, lists[2])))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parts.alias("parts"))
    e = names.ends(F.col("parts"))
    return d.select("id", e["head"].alias("head"), e["body"].alias("body"), names.followed_part(F.col("parts")).alias("followed"), F.when(F.col("parts").isNotNull(), F.size(names.mirror_pairs(F.col("parts")))).alias("pairs"))


@query("chosen_states", f"WITH {FRAMES}, s AS (SELECT session, frame, CASE WHEN session % 3 = 0 AND k > 50 THEN zone END AS a, CASE WHEN session % 5 < 4 THEN zone END AS b FROM f) SELECT session, frame, CASE WHEN max(a) OVER (PARTITION BY session) IS NOT NULL THEN a ELSE b END AS stage FROM s")
def chosen_states(spark, sf_dir):
    f = frames(spark, sf_dir).select("session", "frame", F.when((F.col("session") % 3 == 0) & (F.col("k") > 50), F.col("zone")).alias("state"), F.when(F.col("session") % 5 < 4, F.col("zone")).alias("stage"))
    return names.chosen_state(f).select("session", "frame", "stage")


@query("rounded_rows", "SELECT l_orderkey AS id, l_linenumber AS line, round(l_extendedprice / 7, 4) AS price, round(l_discount / 3, 4) AS discount FROM lineitem")
def rounded_rows(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return names.rounded(d.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 7).alias("price"), (F.col("l_discount") / 3).alias("discount")))


@query("newest_sessions", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_custkey DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 50")
def newest_sessions(spark, sf_dir):
    top = names.ordered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_custkey"), "o_orderdate", "o_custkey", "id", newest=True).limit(50)
    listed = top.agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_custkey", "id")), asc=False).alias("s"))
    return listed.select(F.posexplode("s").alias("at", "r")).select("r.id", (F.col("at") + 1).cast("long").alias("place"))


_POLY = [(10.25, 10.5), (50.25, 30.5), (20.25, 80.5)]


def _near_sql() -> str:
    parts = []
    for i, ((ax, ay), (bx, by)) in enumerate(zip(_POLY, _POLY[1:] + _POLY[:1])):
        dx, dy = bx - ax, by - ay
        parts.append(f"SELECT session, frame, {i} AS e, x, y, {ax} + least(greatest(((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}, 0), 1) * {dx} AS nx, {ay} + least(greatest(((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}, 0), 1) * {dy} AS ny FROM p")
    return " UNION ALL ".join(parts)


@query("nearest_boundary", f"WITH {FRAMES}, p AS (SELECT session, frame, speed AS x, k::DOUBLE AS y FROM f), c AS ({_near_sql()}) SELECT session, frame, round(arg_min(nx, pow(nx - x, 2) + pow(ny - y, 2) + e * 1e-9), 4) AS nx, round(arg_min(ny, pow(nx - x, 2) + pow(ny - y, 2) + e * 1e-9), 4) AS ny FROM c GROUP BY ALL")
def nearest_boundary(spark, sf_dir):
    n = geometry.nearest_on_polygon(F.col("x"), F.col("y"), geometry.polygon(_POLY))
    return frames(spark, sf_dir).select("session", "frame", F.round(n["x"], 4).alias("nx"), F.round(n["y"], 4).alias("ny"))


@query("outer_edges", """WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 7 * 20)::DOUBLE AS px, (s_suppkey % 5 * 25)::DOUBLE AS py FROM supplier),
e AS (SELECT id, 0 AS i, px + 5 AS mx, py + 0.0 AS my, 0.0 AS ox, -1.0 AS oy FROM s UNION ALL SELECT id, 1, px + 10, py + 4, 1, 0 FROM s UNION ALL SELECT id, 2, px + 5, py + 8, 0, 1 FROM s UNION ALL SELECT id, 3, px, py + 4, -1, 0 FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (mx - 50) * ox + (my - 50) * oy DESC, i) AS k FROM e)
SELECT id, mx, my, -ox * 1.0 AS inx, -oy * 1.0 AS iny, CASE WHEN ox <> 0 THEN 12.0 ELSE 14.0 END AS long, true AS past FROM r WHERE k = 1""")
def outer_edges(spark, sf_dir):
    """The outer edge of boxes set about the middle of a 100 by 100 frame, its inward normal, its length drawn out by 2, and whether the box lies past it."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7 * 20).cast("double").alias("px"), (F.col("s_suppkey") % 5 * 25).cast("double").alias("py"))
    corner = lambda dx, dy: F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y"))
    s = s.withColumn("points", F.array(corner(0.0, 0.0), corner(10.0, 0.0), corner(10.0, 8.0), corner(0.0, 8.0)))
    c = geometry.arena_centre(F.lit(100.0), F.lit(100.0), F.col("points"))
    s = s.withColumn("edge", geometry.outer_edge(F.col("points"), c["x"], c["y"]))
    a, b = F.col("edge.a"), F.col("edge.b")
    inward = geometry.inward_normal(a, b, F.col("px") + 5.0, F.col("py") + 4.0)
    long = geometry.extended(a, b, F.lit(2.0))
    return s.select("id", ((a["x"] + b["x"]) / 2).alias("mx"), ((a["y"] + b["y"]) / 2).alias("my"), inward["x"].alias("inx"), inward["y"].alias("iny"), F.hypot(long["b"]["x"] - long["a"]["x"], long["b"]["y"] - long["a"]["y"]).alias("long"), geometry.past_line(F.col("px") + 5.0, F.col("py") + 4.0, a, inward).alias("past"))


@query("row_speeds", f"WITH {FRAMES} SELECT session, frame, CASE WHEN row_number() OVER w = 1 OR dt_us <= 0 OR speed IS NULL OR lag(speed) OVER w IS NULL THEN 0 ELSE round(step / 12 / (dt_us / 1e6) * 1e6, 4) END AS v FROM d WINDOW w AS (PARTITION BY session ORDER BY frame)")
def row_speeds(spark, sf_dir):
    """Micro-units of 12 a second from the previous row, 0 on gaps."""
    f = series.row_speed(frames(spark, sf_dir), scale=12.0)
    return f.select("session", "frame", F.round(F.col("row_speed") * 1e6, 4).alias("v"))


@query("zone_payloads", "SELECT s_suppkey AS file, name, type, 100.0::DOUBLE AS x1, CASE WHEN name = 'box' THEN 20.0::DOUBLE ELSE 0.0 END AS y1 FROM supplier, (VALUES ('box', 'polygon'), ('bar', 'scale')) z(name, type)")
def zone_payloads(spark, sf_dir):
    """Second points in pixels of a 200 by 100 frame."""
    z = zone_files.to_pixels(_payloads(spark, sf_dir), F.lit(200.0), F.lit(100.0))
    at = lambda i: F.round(F.get(F.get("points", 1), i), 4)
    return z.select("file", "name", "type", at(0).alias("x1"), at(1).alias("y1"))


@query("zone_scales", "SELECT s_suppkey AS file, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE round(100.0 / (s_suppkey % 4), 4) END AS px_per_cm FROM supplier")
def zone_scales(spark, sf_dir):
    return zone_files.px_per_cm(_payloads(spark, sf_dir), F.lit(200.0), F.lit(100.0), ["file"]).withColumn("px_per_cm", F.round("px_per_cm", 4))


def _payloads(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.format_string('{"scale": {}, "zones": {"box": {"type": "polygon", "points": [[0.1, 0.2], [0.5, 0.2], [0.5, 0.%d]]}, "bar": {"type": "scale", "points": [[0, 0], [0.5, 0]], "scale_length": %d, "scale_unit": "cm"}, "nil": {}}}', F.col("s_suppkey") % 9 + 1, F.col("s_suppkey") % 4)
    return zone_files.zones_of(s.select(F.col("s_suppkey").alias("file"), text.alias("zones")))


@query("zone_shape_sums", "SELECT n_nationkey AS id, name, round(area * n_nationkey * n_nationkey, 4) AS wide_area FROM nation, (VALUES ('wide', 6000.0), ('box', 1000.0), ('tri', 1300.0)) t(name, area)")
def zone_shape_sums(spark, sf_dir):
    """Each zone's area when it is stretched by each nation's key."""
    listed = zone_table(spark).agg(F.collect_list(F.struct("name", "points"))).scalar()
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), listed.alias("zones")).select("id", F.explode("zones").alias("z")).select("id", "z.*")
    scaled = F.transform("points", lambda p: F.struct((p["x"] * F.col("id")).alias("x"), (p["y"] * F.col("id")).alias("y")))
    return n.select("id", "name", F.round(geometry.area(scaled), 4).alias("wide_area"))
