"""Point in zone by look-up: zones filled once into packed rows of pixels, points rounded to a pixel.

A raster holds, per pixel row, each zone's pixels as 64-bit words. It has width x height bits a zone, whatever number of points is looked up, and goes
to all workers on that bound. A zone's pixels are those whose middle its rounded corners' polygon holds (even-odd),
and those its border passes: of a border line one pixel per column, or per row where it is steep.

Defined results: a point that isn't there, or more than half a pixel outside the frame, is in no zone; zones of fewer than three points hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.functions.geometry import area

_RANK = pa.struct([("area", pa.float64()), ("ord", pa.int32())])
#: Bits of a raster that may go to all workers.
MOST_BITS = 1 << 30


def filled(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """height x width booleans of a polygon with whole-numbered corners."""
    out = np.zeros((height, width), bool)
    if len(points) < 3:
        return out
    x, y = np.arange(width), np.arange(height)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, 0)):
        if ay != by:
            rows = (ay > y) != (by > y)
            at = ax + (y - ay) * (bx - ax) / (by - ay)
            out ^= rows[:, None] & (x[None, :] < at[:, None])
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, 0)):
        steps = max(abs(bx - ax), abs(by - ay))
        k = np.arange(steps + 1)
        # halves go up
        px, py = (np.floor(a + (k * (b - a) / steps if steps else 0 * k) + 0.5).astype(int) for a, b in ((ax, bx), (ay, by)))
        there = (px >= 0) & (px < width) & (py >= 0) & (py < height)
        out[py[there], px[there]] = True
    return out


def rasters(zones: DataFrame, width: int, height: int) -> DataFrame:
    """py, cells: for each pixel row the zones (rank, name, words) that have pixels in it, the smallest by area first."""
    words = -(-width // 64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rank, name, points in zip(*(b.column(c).to_pylist() for c in ("rank", "name", "points"))):
                corners = np.array([[round(p["x"]), round(p["y"])] for p in points], np.int64).reshape(-1, 2)
                bits = np.zeros((height, 64 * words), bool)
                bits[:, :width] = filled(corners, width, height)
                rows = np.flatnonzero(bits.any(1))
                packed = np.packbits(bits[rows], axis=1, bitorder="little").view("<i8")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * words, pa.int32()), pa.array(packed.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([rank] * len(rows), _RANK), pa.array([name] * len(rows), pa.string()), lists], names=["py", "rank", "name", "words"])

    ranked = zones.select(F.struct(area(F.col("points")).alias("area"), "ord").alias("rank"), "name", "points")
    drawn = ranked.repartition("name").mapInArrow(draw, "py long, rank struct<area:double,ord:int>, name string, words array<long>")
    return drawn.groupBy("py").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "words"))).alias("cells"))


def looked_up(points: DataFrame, zones: DataFrame, width: int, height: int, x: str = "x", y: str = "y") -> DataFrame:
    """points with held: the names of all zones that hold a point, the smallest first; the first one is the zone it is in."""
    if width * height * zones.count() > MOST_BITS:
        raise ValueError("the raster is too large to send to all workers: look points up by polygons instead")
    inside = F.col(x).between(-0.5, width - 0.5) & F.col(y).between(-0.5, height - 0.5)
    pixel = lambda c, size: F.when(inside, F.least(F.greatest(F.rint(c), F.lit(0)), F.lit(size - 1)).cast("long"))
    d = points.withColumns({"px": pixel(F.col(x), width), "py": pixel(F.col(y), height)})
    d = d.join(F.broadcast(rasters(zones, width, height)), "py", "left")  # width x height bits a zone, checked above
    bit = F.expr("filter(cells, c -> (shiftrightunsigned(get(c.words, cast(px div 64 AS int)), cast(px % 64 AS int)) & 1) = 1)")
    return d.withColumn("held", F.coalesce(F.transform(bit, lambda c: c["name"]), F.array().cast("array<string>"))).drop("px", "py", "cells")
