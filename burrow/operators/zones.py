"""Which zone a point is in. Zones are a small dimension: joined by a bounding-box condition, or one array beside each point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.functions.geometry import area, in_polygon, on_border


def sized(zones: DataFrame) -> DataFrame:
    """zones (name, ord, points) with bounding box and area."""
    pick = lambda f, of: of(F.transform("points", lambda p: p[f]))
    return zones.withColumns({"x0": pick("x", F.array_min), "x1": pick("x", F.array_max), "y0": pick("y", F.array_min), "y1": pick("y", F.array_max), "area": area(F.col("points"))})


def occupancy(points: DataFrame, zones: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row per point and zone that holds it; zones may overlap."""
    z = sized(zones)
    box = (F.col(x) >= F.col("x0")) & (F.col(x) <= F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) <= F.col("y1"))
    return points.join(z, box).where(in_polygon(F.col(x), F.col(y), F.col("points")))


def located(points: DataFrame, zones: DataFrame, rule: str = "smallest", x: str = "x", y: str = "y", border: bool = False) -> DataFrame:
    """points with zone: the ``smallest`` by area, the ``first`` listed, or the ``deepest`` (by the column depth) that holds it; null if none does. border: its border too.

    All zones are one value, an array in order of preference, which every point is tested with: no point is shuffled or joined.
    """
    order = {"smallest": F.struct("area", "ord"), "first": F.struct("ord"), "deepest": F.struct(-F.col("depth"), F.col("ord")) if "depth" in zones.columns else F.struct("area", "ord")}[rule]
    listed = sized(zones).agg(F.array_sort(F.collect_list(F.struct(order.alias("rank"), "name", "points", "x0", "x1", "y0", "y1"))).alias("zone_list"))
    inner = lambda z: in_polygon(F.col(x), F.col(y), z["points"])
    holds = (lambda z: inner(z) | on_border(F.col(x), F.col(y), z["points"])) if border else inner
    at = lambda z: (F.col(x) >= z["x0"]) & (F.col(x) <= z["x1"]) & (F.col(y) >= z["y0"]) & (F.col(y) <= z["y1"]) & holds(z)
    return points.withColumn("zone_list", listed.scalar()).withColumn("zone", F.get(F.filter("zone_list", at), 0)["name"]).drop("zone_list")


def heat(points: DataFrame, dt: str, width: float, height: float, bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """session, bx, by, time: time by cell of a bins x bins grid; the far edges belong to the last cells."""
    cell = lambda c, size: F.least(F.floor(F.col(c) / (size / bins)), F.lit(bins - 1))
    inside = (F.col(x) >= 0) & (F.col(x) <= width) & (F.col(y) >= 0) & (F.col(y) <= height)
    return points.where(inside).groupBy("session", cell(x, width).alias("bx"), cell(y, height).alias("by")).agg(F.sum(dt).alias("time_us"))


def frame_size(points: DataFrame, centres: DataFrame, zone: str = "zone", x: str = "x", least: int = 20) -> DataFrame:
    """session, points, size: least squares of pixel positions against relative zone centres; null below ``least`` points."""
    j = points.join(centres, zone).where(F.col(x).isNotNull() & F.col("c").isNotNull())
    out = j.groupBy("session").agg(F.count("*").alias("points"), F.sum(F.col(x) * F.col("c")).alias("xc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    return out.select("session", "points", F.when((F.col("points") >= least) & (F.col("cc") > 0), F.col("xc") / F.col("cc")).alias("size"))
