"""Queries of points, zones and angles."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import geometry
from burrow.operators import series, zones
from burrow.plans.registry import FRAMES, frames, query

#: Zones of the plane (x = value, y = k): a triangle, an inner box, a wide box; they overlap.
ZONES = {"wide": [(0, 0), (60, 0), (60, 100), (0, 100)], "box": [(5.5, 20.5), (30.5, 20.5), (30.5, 60.5), (5.5, 60.5)], "tri": [(10.25, 10.5), (50.25, 30.5), (20.25, 80.5)]}


def zone_table(spark):
    rows = [(n, i, [(float(x), float(y)) for x, y in p]) for i, (n, p) in enumerate(ZONES.items())]
    return spark.createDataFrame(rows, "name string, ord int, points array<struct<x:double,y:double>>")


def _inside(points) -> str:
    """The even-odd rule in SQL for one polygon over x, y."""
    edges = zip(points, points[1:] + points[:1])
    terms = [f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < {ax} + (y - {ay}) * ({bx - ax}) / ({by - ay}) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in edges if ay != by]
    return "((" + " + ".join(terms) + ") % 2 = 1)"


_PTS = f"{FRAMES}, p AS (SELECT session, frame, dt_us, speed AS x, k::DOUBLE AS y, zone FROM d)"


@query("point_in_polygon", f"WITH {_PTS} SELECT session, frame, coalesce({_inside(ZONES['tri'])}, false) AS inside FROM p")
def point_in_polygon(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("session", "frame", F.coalesce(geometry.in_polygon(F.col("x"), F.col("y"), geometry.polygon(ZONES["tri"])), F.lit(False)).alias("inside"))


@query("zone_occupancy", f"WITH {_PTS} " + " UNION ALL ".join(f"SELECT session, '{n}' AS name, count(*) AS frames, sum(dt_us)::BIGINT AS time_us FROM p WHERE {_inside(z)} GROUP BY session" for n, z in ZONES.items()))
def zone_occupancy(spark, sf_dir):
    f = series.intervals(frames(spark, sf_dir))
    return zones.occupancy(f, zone_table(spark)).groupBy("session", "name").agg(F.count("*").alias("frames"), F.sum("dt_us").alias("time_us"))


_SMALL = " ".join(f"WHEN {_inside(ZONES[n])} THEN '{n}'" for n in ("box", "tri", "wide"))
_FIRST = " ".join(f"WHEN {_inside(ZONES[n])} THEN '{n}'" for n in ("wide", "box", "tri"))
_DEEP = " ".join(f"WHEN {_inside(ZONES[n])} THEN '{n}'" for n in ("tri", "box", "wide"))


@query("smallest_zone", f"WITH {_PTS} SELECT session, frame, CASE {_SMALL} END AS zone FROM p")
def smallest_zone(spark, sf_dir):
    return zones.located(frames(spark, sf_dir).select("session", "frame", "x", "y"), zone_table(spark)).select("session", "frame", "zone")


@query("first_match_zone", f"WITH {_PTS} SELECT session, frame, CASE {_FIRST} END AS zone FROM p")
def first_match_zone(spark, sf_dir):
    return zones.located(frames(spark, sf_dir).select("session", "frame", "x", "y"), zone_table(spark), "first").select("session", "frame", "zone")


@query("deepest_zone", f"WITH {_PTS} SELECT session, frame, CASE {_DEEP} END AS zone FROM p")
def deepest_zone(spark, sf_dir):
    z = zone_table(spark).withColumn("depth", F.element_at(F.create_map(F.lit("wide"), F.lit(0), F.lit("box"), F.lit(1), F.lit("tri"), F.lit(2)), F.col("name")))
    return zones.located(frames(spark, sf_dir).select("session", "frame", "x", "y"), z, "deepest").select("session", "frame", "zone")


@query("facing_angle", f"""WITH {_PTS}, h AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY session ORDER BY frame)),
v AS (SELECT *, sqrt(pow(x-bx,2)+pow(y-by_,2)) * sqrt(pow(30-x,2)+pow(50-y,2)) AS sz, (x-bx)*(30-x)+(y-by_)*(50-y) AS dot FROM h)
SELECT session, frame, round(CASE WHEN sz > 0 THEN degrees(acos(least(greatest(dot/sz, -1), 1))) END, 4) AS angle FROM v""")
def facing_angle(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"bx": F.lag("x").over(series.along()), "by": F.lag("y").over(series.along())})
    a = geometry.facing(F.col("bx"), F.col("by"), F.col("x"), F.col("y"), F.lit(30.0), F.lit(50.0))
    return f.select("session", "frame", F.round(a, 4).alias("angle"))


@query("turning", f"""WITH {_PTS}, h AS (SELECT session, frame, degrees(atan2(y - lag(y) OVER w, x - lag(x) OVER w)) AS a FROM p WINDOW w AS (PARTITION BY session ORDER BY frame)),
t AS (SELECT *, a - lag(a) OVER (PARTITION BY session ORDER BY frame) AS dd FROM h) SELECT session, frame, round(dd - 360*ceil((dd - 180)/360), 4) AS turn FROM t""")
def turning(spark, sf_dir):
    w = series.along()
    f = frames(spark, sf_dir).withColumn("a", geometry.heading(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return f.select("session", "frame", F.round(geometry.turn(F.col("a"), F.lag("a").over(w)), 4).alias("turn"))


@query("nearest_point", f"""WITH {_PTS}, t AS (SELECT *, least(greatest(((x-10)*30 + (y-10)*40)/2500.0, 0), 1) AS t FROM p) SELECT session, frame, round(10 + t*30, 4) AS nx, round(10 + t*40, 4) AS ny, sign(30*(y-10) - 40*(x-10))::DOUBLE AS side FROM t""")
def nearest_point(spark, sf_dir):
    f = frames(spark, sf_dir)
    seg = [F.lit(v) for v in (10.0, 10.0, 40.0, 50.0)]
    n = geometry.nearest_on_segment(F.col("x"), F.col("y"), *seg)
    return f.select("session", "frame", F.round(n["x"], 4).alias("nx"), F.round(n["y"], 4).alias("ny"), geometry.side(F.col("x"), F.col("y"), *seg).alias("side"))


@query("occupancy_heatmap", f"""WITH {_PTS} SELECT session, least(floor(x/(100.0/10)), 9)::BIGINT AS bx, least(floor(y/(100.0/10)), 9)::BIGINT AS "by", sum(dt_us)::BIGINT AS time_us FROM p WHERE x >= 0 AND x <= 100 AND y >= 0 AND y <= 100 GROUP BY ALL""")
def occupancy_heatmap(spark, sf_dir):
    return zones.heat(series.intervals(frames(spark, sf_dir)), "dt_us", 100.0, 100.0, 10)


@query("frame_fit_ls", f"""WITH {_PTS}, c AS (SELECT * FROM (VALUES ('click', 0.2), ('view', 0.5), ('error', 0.8)) t(zone, c)) SELECT session, count(*) AS points, round(CASE WHEN count(*) >= 20 AND sum(c*c) > 0 THEN sum(x*c)/sum(c*c) END, 4) AS size FROM p JOIN c USING (zone) WHERE x IS NOT NULL GROUP BY session""")
def frame_fit_ls(spark, sf_dir):
    c = spark.createDataFrame([("click", 0.2), ("view", 0.5), ("error", 0.8)], "zone string, c double")
    return zones.frame_size(frames(spark, sf_dir), c).withColumn("size", F.round("size", 4))


@query("zone_shapes", "SELECT * FROM (VALUES ('wide', 6000.0::DOUBLE, 30.0::DOUBLE, 50.0::DOUBLE), ('box', 1000.0, 18.0, 40.5), ('tri', 1300.0, 26.9167, 40.5)) t(name, area, cx, cy)")
def zone_shapes(spark, sf_dir):
    c = geometry.centroid(F.col("points"))
    return zone_table(spark).select("name", F.round(geometry.area(F.col("points")), 4).alias("area"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"))
