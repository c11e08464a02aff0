"""Zones of session files and zone files: payloads in three shapes, coordinate spaces and scales.

A payload is a list of zones, a mapping from name to zone, or either of these under the key ``zones`` of an envelope. A zone has
``points`` (``values`` in old files), or a centre with axes or a radius; a zone with neither is none.

Defined results: text that isn't JSON, and an empty payload, give no zones; a zone without a name is ``zone``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIRS = "array<array<double>>"
_ZONE = f"struct<name:string,type:string,points:{_PAIRS},values:{_PAIRS},center:array<double>,semi_axes:array<double>,radius_norm:double,coord_space:string,shape_dim:array<double>,enabled:boolean,scale_length:string,scale_unit:string>"


def zones_of(payloads: DataFrame, text: str = "zones") -> DataFrame:
    """One row per zone of each payload: the other columns, ord, name, type, points, center, semi_axes, radius_norm, coord_space, shape_dim, enabled, scale_length, scale_unit."""
    raw = F.col(text)
    enveloped = F.get_json_object(raw, "$.zones")
    inner = F.when(raw.rlike(r"^\s*\{") & enveloped.rlike(r"^\s*[\[{]"), enveloped).otherwise(raw)
    listed = F.when(inner.rlike(r"^\s*\["), F.from_json(inner, f"array<{_ZONE}>"))
    mapped = F.when(inner.rlike(r"^\s*\{"), F.transform(F.map_entries(F.from_json(inner, f"map<string,{_ZONE}>")), lambda e: e["value"].withField("name", e["key"])))
    kept = [c for c in payloads.columns if c != text]
    d = payloads.select(*kept, F.posexplode(F.coalesce(listed, mapped)).alias("ord", "z")).where("z IS NOT NULL")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    points = F.filter(F.when(some(F.col("z.points")), F.col("z.points")).otherwise(F.col("z.values")), lambda p: F.size(p) >= 2)
    d = d.withColumn("points", points).where(some(F.col("points")) | (some(F.col("z.center")) & (some(F.col("z.semi_axes")) | F.coalesce(F.col("z.radius_norm") != 0, F.lit(False)))))
    return d.select(*kept, "ord", F.coalesce(F.nullif(F.trim("z.name"), F.lit("")), F.lit("zone")).alias("name"), "z.type", "points", "z.center", "z.semi_axes", "z.radius_norm", "z.coord_space", "z.shape_dim", F.coalesce("z.enabled", F.lit(True)).alias("enabled"), F.col("z.scale_length").try_cast("double").alias("scale_length"), F.lower("z.scale_unit").alias("scale_unit"))


def looks_normalized(points: Column, coord_space: Column) -> Column:
    """Whether points are in 0-1 space: as the zone says, else if all of them lie there."""
    inside = F.forall(points, lambda p: F.get(p, 0).between(0, 1) & F.get(p, 1).between(0, 1)) & (F.size(points) > 0)
    return F.when(coord_space.isin("normalized", "pixel"), coord_space == "normalized").otherwise(F.coalesce(inside, F.lit(False)))


def _drawn(i: int) -> Column:
    d = F.get("shape_dim", i)
    return F.when((F.get("shape_dim", 0) > 0) & (F.get("shape_dim", 1) > 0), d)


def scales(width: Column, height: Column) -> tuple[Column, Column]:
    """Factors from a zone's own coordinates to pixels of the frame: its size for normalised zones, else the ratio to the size it was drawn at; 1 where that isn't known."""
    known = (width > 0) & (height > 0)
    normal = looks_normalized(F.col("points"), F.col("coord_space"))
    return tuple(F.coalesce(F.when(normal, F.when(known, size).otherwise(_drawn(i))).when(known, size / _drawn(i)), F.lit(1.0)) for i, size in ((0, width), (1, height)))


def to_pixels(zones: DataFrame, width: Column, height: Column) -> DataFrame:
    """zones with points, center and semi_axes in pixels of a frame of this size."""
    sx, sy = scales(width, height)
    pair = lambda p: F.array(F.get(p, 0) * F.col("_sx"), F.get(p, 1) * F.col("_sy"))
    d = zones.withColumns({"_sx": sx, "_sy": sy})
    d = d.withColumns({"points": F.transform("points", pair), **{c: F.when(F.size(c) == 2, pair(F.col(c))).otherwise(F.col(c)) for c in ("center", "semi_axes")}})
    return d.withColumns({"coord_space": F.lit("pixel"), "shape_dim": F.array(F.floor(width), F.floor(height)).cast("array<double>")}).drop("_sx", "_sy")


def to_norm(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A pixel as a point of 0-1 space; null without a frame size."""
    return F.when((width > 0) & (height > 0), F.struct((x / width).alias("x"), (y / height).alias("y")))


def from_norm(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct((x * width).alias("x"), (y * height).alias("y"))


def px_per_cm(zones: DataFrame, width: Column, height: Column, by: list[str]) -> DataFrame:
    """by, px_per_cm: the scale of the first ``scale`` zone with two points at least one pixel apart and a length; 0 without one."""
    sx, sy = scales(width, height)
    a, b = F.get("points", 0), F.get("points", 1)
    length_px = F.hypot((F.get(b, 0) - F.get(a, 0)) * sx, (F.get(b, 1) - F.get(a, 1)) * sy)
    cm = F.col("scale_length") * F.when(F.col("scale_unit") == "mm", 0.1).when(F.col("scale_unit").isin("m", "metre", "meter"), 100.0).otherwise(1.0)
    usable = (F.col("type") == "scale") & (F.size("points") >= 2) & (F.col("scale_length") > 0) & (length_px >= 1)
    found = F.min_by(F.when(usable, length_px / cm), F.when(usable, F.col("ord")))
    return zones.groupBy(*by).agg(F.coalesce(found, F.lit(0.0)).alias("px_per_cm"))
