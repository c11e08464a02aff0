"""Queries of what a recording is: its clock, its zones' space, its scale, where its files lie, and what its zones send."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import geometry, scalars
from burrow.operators import bins, clocks, measures, rules, series
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.sources import catalog

_RATE = "1000.0 / CASE WHEN {0} > 0 THEN {0} END"


def _series(name: str, rows: str) -> str:
    return f"""{name}0 AS (SELECT session, t, t - lag(t) OVER (PARTITION BY session ORDER BY frame) AS st FROM ({rows})),
{name} AS (SELECT session, count(*) AS n, max(t) AS fin, count(*) FILTER (WHERE st < 0) AS back, quantile_cont(CASE WHEN st > 0 THEN st END, 0.5) AS med, stddev_pop(CASE WHEN st > 0 THEN st END) AS sd FROM {name}0 GROUP BY session)"""


@query("clock_models", f"""WITH {FRAMES}, {_series("a", "SELECT session, frame, t_us/1e8 * CASE WHEN session % 10 = 0 THEN -1 ELSE 1 END AS t FROM d WHERE session % 5 = 0")}, {_series("b", "SELECT session, frame, (t_us - min(t_us) OVER (PARTITION BY session))/1e8 * CASE WHEN session % 7 = 1 THEN 0 ELSE 1 END AS t FROM d WHERE session % 5 = 1")},
s AS (SELECT session, count(*) + session % 2 AS rows, CASE WHEN session % 5 IN (1, 2, 3) THEN (session % 4 * 10)::DOUBLE END AS cf, CASE WHEN session % 5 IN (0, 1, 2, 3) THEN count(*) + session % 2 END AS cn, CASE WHEN session % 3 = 0 THEN 20.0 END AS uf FROM d GROUP BY session),
j AS (SELECT s.*, coalesce(a.n >= 2, false) AS ha, coalesce(b.n >= 2 AND b.fin > 0 AND cn IS NOT NULL, false) AS hb, a.n AS an, a.back AS ab, a.med AS am, a.sd AS asd, b.n AS bn, b.back AS bb, b.med AS bm, b.sd AS bsd FROM s LEFT JOIN a USING (session) LEFT JOIN b USING (session)),
k AS (SELECT *, NOT ha AND NOT hb AND coalesce(cf > 0 AND cn IS NOT NULL, false) AS hc FROM j), o AS (SELECT *, hc AND coalesce(abs(cf - uf)/cf > 0.05, false) AS ov, NOT ha AND NOT hb AND NOT hc AND uf IS NOT NULL AS hu FROM k),
m AS (SELECT *, CASE WHEN ha THEN am WHEN hb THEN bm WHEN ov THEN 1000/uf WHEN hc THEN 1000/cf END AS st FROM o)
SELECT session, CASE WHEN ha THEN 'recorded' WHEN hb THEN 'container_pts' WHEN ov THEN 'user' WHEN hc THEN 'container_fps' WHEN hu THEN 'user' ELSE 'index' END AS source,
round(coalesce(CASE WHEN ha THEN 1000/am WHEN hb THEN 1000/bm WHEN ov OR hu THEN uf WHEN hc THEN cf END, 0), 4) AS fps, coalesce(CASE WHEN ha THEN asd/am > 0.05 WHEN hb THEN bsd/bm > 0.05 END, false) AS vfr,
array_to_string(list_filter([CASE WHEN (ha AND ab > 0) OR (hb AND bb > 0) THEN 'backward' END, CASE WHEN st < 5 OR st > 1000 THEN 'implausible' END, CASE WHEN an IS NULL THEN 'no_times' END, CASE WHEN NOT ha AND NOT hb AND cn IS NOT NULL THEN 'no_stamps' END,
CASE WHEN hb AND abs(1000/bm - uf)/(1000/bm) > 0.05 THEN 'user_differs' END, CASE WHEN ov THEN 'user_overrides' END, CASE WHEN (ha AND cn IS NOT NULL AND an <> cn) OR (hb AND bn <> cn) THEN 'count_differs' END, CASE WHEN NOT (ha OR hb OR hc OR hu) THEN 'no_rate' END], lambda w: w IS NOT NULL), ',') AS warnings FROM m""")
def clock_models(spark, sf_dir):
    """A fifth of the sessions each with times of their own, with a container's stamps, with a container's rate (two fifths), with neither."""
    f = frames(spark, sf_dir)
    s, t = F.col("session"), F.col("t_us") / 1e8
    from pyspark.sql import Window

    recorded = f.where(s % 5 == 0).select("session", "frame", (t * F.when(s % 10 == 0, -1).otherwise(1)).alias("t_ms"))
    since = (F.col("t_us") - F.min("t_us").over(Window.partitionBy("session"))) / 1e8
    stamps = f.where(s % 5 == 1).select("session", "frame", (since * F.when(s % 7 == 1, 0).otherwise(1)).alias("t_ms"))
    n = F.count("*") + s % 2
    sessions = f.groupBy("session").agg(F.when((s % 5).isin(1, 2, 3), (s % 4 * 10).cast("double")).alias("container_fps"), F.when(s % 5 != 4, n).alias("container_frames"), F.when(s % 3 == 0, 20.0).alias("user_fps"))
    return clocks.clock_models(sessions, recorded, stamps).select("session", "source", F.round("fps", 4).alias("fps"), "vfr", F.array_join("warnings", ",").alias("warnings"))


@query("rezoned_frames", f"""WITH {FRAMES}, p AS (SELECT *, CASE WHEN session % 4 = 0 THEN 'na' ELSE zone END AS loc, CASE WHEN session % 3 = 0 THEN 300 ELSE 500 END AS w FROM d),
s AS (SELECT session, avg(CASE WHEN speed/w*1e4 < -1 OR speed/w*1e4 > 10001 OR k/100.0*1e4 > 10001 THEN 1.0 ELSE 0.0 END) <= 0.02 AS fits, max(CASE WHEN loc <> 'na' THEN 1 ELSE 0 END) = 1 AS has FROM p GROUP BY session)
SELECT session, frame, CASE WHEN session % 6 = 3 OR fits OR NOT has THEN CASE WHEN speed < 200 THEN 'left' ELSE 'right' END ELSE loc END AS zone FROM p JOIN s USING (session)""")
def rezoned_frames(spark, sf_dir):
    """Sessions whose points lie in the declared frame, or whose zones were changed, or that have no zones of their own, get computed zones."""
    s = F.col("session")
    f = frames(spark, sf_dir).withColumn("location", F.when(s % 4 == 0, "na").otherwise(F.col("zone"))).withColumn("computed", F.when(F.col("x") < 200, "left").otherwise("right"))
    spaces = f.select("session").distinct().select("session", F.when(s % 3 == 0, 300.0).otherwise(500.0).alias("width"), F.lit(100.0).alias("height"), (s % 6 == 3).alias("edited"))
    return clocks.rezoned(f, clocks.rezoning(f, spaces), "computed").select("session", "frame", "zone")


@query("head_rules", f"""WITH {FRAMES}, p AS (SELECT session, frame, t_us, speed + (k % 7) - 3 AS hx, k + (frame % 5) - 2 AS hy, speed + 2 AS nx, k::DOUBLE AS ny, speed - 4 AS tx, k + (frame % 3) - 1 AS ty FROM d),
v AS (SELECT *, CASE WHEN sqrt(pow(nx - tx, 2) + pow(ny - ty, 2)) >= 1e-6 AND sqrt(pow(hx - nx, 2) + pow(hy - ny, 2)) >= 1e-6 THEN abs(degrees(atan2((nx - tx)*(hy - ny) - (ny - ty)*(hx - nx), (nx - tx)*(hx - nx) + (ny - ty)*(hy - ny)))) END AS ha,
CASE WHEN sqrt(pow(hx - tx, 2) + pow(hy - ty, 2)) >= 1e-6 AND sqrt(pow(250 - hx, 2) + pow(50 - hy, 2)) >= 1e-6 THEN abs(degrees(atan2((hx - tx)*(50 - hy) - (hy - ty)*(250 - hx), (hx - tx)*(250 - hx) + (hy - ty)*(50 - hy)))) END AS fa FROM p),
r AS (SELECT session, frame, 'bent' AS rule, coalesce(ha > 60, false) AS active FROM v UNION ALL SELECT session, frame, 'straight', coalesce(ha < 20, false) FROM v UNION ALL SELECT session, frame, 'looks', coalesce(fa <= 30, false) FROM v UNION ALL SELECT session, frame, 'nowhere', false FROM v)
SELECT session, frame, rule, active, active AND NOT coalesce(lag(active) OVER (PARTITION BY session, rule ORDER BY frame), false) AS fired FROM r""")
def head_rules(spark, sf_dir):
    """Rules of the head's angle to the body and of facing a point; one without a point never holds."""
    f = series.intervals(frames(spark, sf_dir))
    k, n = F.col("k"), F.col("frame")
    f = f.withColumns({"hx": F.col("x") + k % 7 - 3, "hy": F.col("y") + n % 5 - 2, "nx": F.col("x") + 2, "ny": F.col("y"), "tx": F.col("x") - 4, "ty": F.col("y") + n % 3 - 1})
    R = rules.Rule
    return rules.states(rules.features(f), [R("bent", "head_angle_gt", 60.0), R("straight", "head_angle_lt", 20.0), R("looks", "facing_line", target=(250.0, 50.0)), R("nowhere", "facing_line")])


@query("zone_policies", """WITH z AS (SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'coord' WHEN 1 THEN 'event_enter' WHEN 2 THEN 'event_enter_exit' WHEN 3 THEN NULL ELSE 'other' END AS mode, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'Place_X' WHEN 2 THEN 'y' ELSE 'spot' END AS var, CASE WHEN n_nationkey % 4 <> 0 THEN 'in_' || n_nationkey ELSE '' END AS ent, CASE WHEN n_nationkey % 3 <> 0 THEN 'out_' || n_nationkey END AS ext FROM nation)
SELECT name, 'nose' AS part, 'coordinate' AS kind, NULL::VARCHAR AS condition, CASE WHEN var = '' THEN 'loc_center' ELSE var END AS target, var IN ('Place_X', 'y') AS carries_pixels FROM z WHERE coalesce(mode, 'coord') = 'coord'
UNION ALL SELECT name, 'nose', 'event', 'in_zone', ent, false FROM z WHERE mode IN ('event_enter', 'event_enter_exit') AND ent <> '' UNION ALL SELECT name, 'nose', 'event', 'exit_edge', ext, false FROM z WHERE mode = 'event_enter_exit' AND ext IS NOT NULL""")
def zone_policies(spark, sf_dir):
    k = F.col("n_nationkey")
    mode = F.when(k % 5 == 0, "coord").when(k % 5 == 1, "event_enter").when(k % 5 == 2, "event_enter_exit").when(k % 5 == 4, "other")
    variable = F.element_at(F.array(*map(F.lit, ("", "Place_X", "y", "spot", "spot"))), (F.col("n_regionkey") + 1).cast("int"))
    z = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), mode.alias("transmit_mode"), variable.alias("coord_var"), F.when(k % 4 != 0, F.concat(F.lit("in_"), k)).otherwise("").alias("event_on_enter"), F.when(k % 3 != 0, F.concat(F.lit("out_"), k)).alias("event_on_exit"))
    return rules.zone_policies(z, "nose")


@query("scale_forms", """WITH p AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 7 AS k FROM part)
SELECT id, round(CASE k WHEN 0 THEN 0.01/n WHEN 1 THEN 0.01/(n + 0.5) WHEN 2 THEN 0.01/(5.0*n/4) WHEN 3 THEN 0.01/(n/22.0) WHEN 4 THEN 0.01/(2.0*n) WHEN 5 THEN 1 ELSE 0.01/n END, 8) AS metres, round(CASE k % 4 WHEN 0 THEN n/7.0 WHEN 1 THEN n/70.0 WHEN 2 THEN n/(3*25.4) END, 6) AS per_mm FROM p""")
def scale_forms(spark, sf_dir):
    """Metres a pixel of every form of scale, and pixels a millimetre of calibration zones in several units."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    scale = F.when(k == 0, n).when(k == 1, text('{"px_per_cm": ', n, '.5}')).when(k == 2, text('{"length": 4, "values": [[0, 0], [', (F.col("p_size") * 3).cast("string"), ", ", (F.col("p_size") * 4).cast("string"), "]]}"))
    scale = scale.when(k == 3, text("[10, 5, 10, ", (F.col("p_size") + 5).cast("string"), "]")).when(k == 4, text('{"length": "0.5", "values": [1, ', (F.col("p_size") + 1).cast("string"), "]}")).when(k == 5, '{"length": 0, "values": [1, 2]}')
    q = F.col("p_partkey") % 7 % 4
    mm = scalars.px_per_mm(F.col("p_size").cast("double"), F.when(q == 0, 7.0).when(q == 3, 0.0), F.when(q == 1, 7.0).when(q == 2, 3.0), F.when(q == 1, "cm").when(q == 2, "IN"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(scalars.m_per_px(scale, F.when(k == 6, n)), 8).alias("metres"), F.round(mm, 6).alias("per_mm"))


@query("project_recordings", """WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS m FROM customer)
SELECT '/rig' || k || '/exp/p' || k AS project, CASE m WHEN 0 THEN '/rig' || k || '/exp/p' || k || '/data/long' || k || '/010203/a.tsv' WHEN 1 THEN '/rig' || k || '/exp/p' || k || '/data/040506/mcu/b.tsv' WHEN 2 THEN '/rig' || k || '/data/p' || k || '/070809/video/s_video_data.txt' WHEN 3 THEN '/rig' || k || '/exp/p' || k || '/data/other/101112/c_video_data_2.txt' END AS path,
CASE WHEN m IN (0, 1) THEN 'mcu' ELSE 'video' END AS kind, CASE m WHEN 0 THEN '010203' WHEN 1 THEN '040506' WHEN 2 THEN '070809' ELSE '101112' END AS day, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS tier FROM c WHERE m < 4""")
def project_recordings(spark, sf_dir):
    """Files in a folder named for the project, in dates of its own data folder, in a named folder further up, in another's dates, or nowhere they count."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 6).alias("m"))
    p = F.concat(F.lit("/rig"), "k", F.lit("/exp/p"), "k")
    at = lambda m, *parts: F.when(F.col("m") == m, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    paths = [
        at(0, p, "/data/long", F.col("k"), "/010203/a.tsv"), at(0, p, "/data/999999/z.tsv"), at(0, p, "/data/long", F.col("k"), "/010203/deep/er/a.tsv"),
        at(1, p, "/data/040506/mcu/b.tsv"), at(1, p, "/data/other/030303/x.tsv"),
        at(2, "/rig", F.col("k"), "/data/p", F.col("k"), "/070809/video/s_video_data.txt"), at(2, "/rig", F.col("k"), "/data/p", F.col("k"), "/notes/s.tsv"), at(2, p, "/data/other/020202/x.tsv"),
        at(3, p, "/data/other/101112/c_video_data_2.txt"), at(4, p, "/data/other/1011/c.tsv"), at(4, "/elsewhere/data/010101/c.tsv"),
    ]
    files = c.select(F.explode(F.array_compact(F.array(*paths))).alias("path"))
    projects = c.select(p.alias("project"), F.array(F.concat(F.lit("long"), "k"), F.concat(F.lit("p"), "k")).alias("names"))
    return catalog.recordings(projects, files)


@query("discrimination", f"""WITH {FRAMES}, z AS (SELECT session, zone AS name, sum(dt_us)::BIGINT AS us FROM d WHERE zone IN ('click', 'view') OR (session % 3 = 0 AND zone = 'error') GROUP BY ALL), n AS (SELECT session, count(*) AS n, sum(us)::BIGINT AS total_us, arg_min(us, name) AS a, arg_max(us, name) AS b FROM z GROUP BY session)
SELECT session, total_us, round((b - a)/total_us, 4) AS index, round(100*b/total_us, 2) AS percent FROM n WHERE n = 2 AND total_us > 0""")
def discrimination(spark, sf_dir):
    f = series.intervals(frames(spark, sf_dir)).where("zone IN ('click', 'view') OR (session % 3 = 0 AND zone = 'error')")
    return measures.discrimination(f.groupBy("session", F.col("zone").alias("name")).agg(F.sum("dt_us").alias("us")))


@query("bin_labels", "SELECT l_orderkey AS id, l_linenumber AS line, 'bin' || (l_linenumber % 3 + 1) || 'of3' AS third, CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber/2)::BIGINT::VARCHAR ELSE (l_linenumber//2)::VARCHAR || '.5' END || '-' || (l_linenumber + 10) || 's' AS span FROM lineitem")
def bin_labels(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("line"), bins.ordinal_label(n % 3, 3).alias("third"), bins.span_label(n / 2, n + 10).alias("span"))


@query("least_moves", f"WITH {FRAMES} SELECT session, frame, round(CASE WHEN step >= 60 THEN step ELSE 0 END, 4) AS step FROM d")
def least_moves(spark, sf_dir):
    """Steps below a least move are none."""
    return series.steps(series.intervals(frames(spark, sf_dir)), min_move=60.0).select("session", "frame", F.round("step", 4).alias("step"))


@query("signed_angles", f"""WITH {FRAMES}, v AS (SELECT session, frame, speed - 250 AS ux, k - 50.0 AS uy, lag(speed) OVER w - 250 AS vx, lag(k) OVER w - 50.0 AS vy FROM d WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, frame, round(CASE WHEN vx IS NOT NULL AND sqrt(ux*ux + uy*uy) >= 1e-6 AND sqrt(vx*vx + vy*vy) >= 1e-6 THEN degrees(atan2(ux*vy - uy*vx, ux*vx + uy*vy)) END, 4) + 0.0 AS angle FROM v""")
def signed_angles(spark, sf_dir):
    w = series.along()
    f = frames(spark, sf_dir).select("session", "frame", (F.col("x") - 250).alias("ux"), (F.col("y") - 50).alias("uy"), (F.lag("x").over(w) - 250).alias("vx"), (F.lag("y").over(w) - 50).alias("vy"))
    return f.select("session", "frame", (F.round(geometry.between(*(F.col(c) for c in ("ux", "uy", "vx", "vy"))), 4) + 0.0).alias("angle"))


@query("identity_checks", f"""WITH {FRAMES}, w AS (SELECT session, (max(t_us) - min(t_us))::DOUBLE AS span, sum(step) AS path, sum(dt_us) FILTER (WHERE zone IS NOT NULL)::DOUBLE AS z FROM d GROUP BY session),
c AS (SELECT session, unnest([{{'c': 'duration', 'e': span}}, {{'c': 'width_distance', 'e': path}}, {{'c': 'width_zone_time', 'e': z}}, {{'c': 'count_distance', 'e': path}}, {{'c': 'count_zone_time', 'e': z}}, {{'c': 'edges_distance', 'e': path}}, {{'c': 'edges_zone_time', 'e': z}}, {{'c': 'zone_distance', 'e': path}}, {{'c': 'zone_time', 'e': span}}, {{'c': 'mean_speed', 'e': path*1e6/span}}]) AS r FROM w)
SELECT session, r.c AS "check", round(r.e, 3) AS expected, round(r.e, 3) AS actual, true AS ok FROM c""")
def identity_checks(spark, sf_dir):
    """Every session's parts add up to its whole, by bins of a day, three bins and an edge; all frames are in zones here."""
    from burrow.operators import checks

    d = checks.identities(frames(spark, sf_dir), 86_400_000_000, 3, (600_000_000_000,))
    return d.select("session", "check", F.round("expected", 3).alias("expected"), F.round("actual", 3).alias("actual"), "ok")
