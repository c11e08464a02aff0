"""Rigid-shape operators over long keypoints (session, frame, part, x, y; null where a part is missing).

A similarity transform of a shape onto a frame's visible parts has a closed form in sums over the
parts, so every fit here is one aggregation by frame, and re-estimating the shape is one by part.
Frames never meet in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.repair import framed, learned_shapes

KEYS = ("session", "frame")


def fits(points: DataFrame, shape: DataFrame) -> DataFrame:
    """session, frame, n, ar, ai, br, bi: z = a s + b of each frame over its visible parts; null with fewer than two.

    ``shape`` has session, part, sx, sy. a and b are complex numbers in two columns each.
    """
    j = points.where("x IS NOT NULL AND y IS NOT NULL").join(shape, ["session", "part"])
    s = j.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(f"m{c}") for c in ("x", "y", "sx", "sy")),
        F.avg(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")).alias("ss"),
        F.avg(F.col("x") * F.col("sx") + F.col("y") * F.col("sy")).alias("re"),
        F.avg(F.col("y") * F.col("sx") - F.col("x") * F.col("sy")).alias("im"),
    )
    size = F.col("ss") - F.col("msx") * F.col("msx") - F.col("msy") * F.col("msy")
    ok = (F.col("n") >= 2) & (size > 1e-12)
    ar = F.when(ok, (F.col("re") - F.col("mx") * F.col("msx") - F.col("my") * F.col("msy")) / size)
    ai = F.when(ok, (F.col("im") - F.col("my") * F.col("msx") + F.col("mx") * F.col("msy")) / size)
    s = s.withColumns({"ar": ar, "ai": ai})
    return s.select(*KEYS, "n", "ar", "ai", (F.col("mx") - F.col("ar") * F.col("msx") + F.col("ai") * F.col("msy")).alias("br"), (F.col("my") - F.col("ar") * F.col("msy") - F.col("ai") * F.col("msx")).alias("bi"))


def canonical_shape(points: DataFrame, rounds: int = 8, anchors: int = 2) -> DataFrame:
    """session, part, sx, sy: the mean shape of a session with missing parts, by fitting and averaging in turns until it settles (``repair.learned_shapes``)."""
    parts = [r["part"] for r in points.select("part").distinct().orderBy("part").collect()]  # an animal's parts, a handful
    if not parts:
        return points.select("session", "part", F.col("x").alias("sx"), F.col("y").alias("sy"))
    timed = points.withColumns({"t_us": F.lit(0).cast("long"), "conf": F.lit(None).cast("double")})
    shapes = learned_shapes(framed(timed, parts), len(parts), anchors, rounds)
    cells = F.array(*(F.struct(F.lit(p).alias("part"), F.get("sx", F.lit(i)).alias("sx"), F.get("sy", F.lit(i)).alias("sy")) for i, p in enumerate(parts)))
    return shapes.select("session", F.explode(cells).alias("p")).select("session", "p.*")


def residuals(points: DataFrame, shape: DataFrame) -> DataFrame:
    """points with px, py (where the fit puts the part), residual and n (visible parts); null where the frame has no fit."""
    f = fits(points, shape)
    j = points.join(shape, ["session", "part"], "left").join(f, [*KEYS], "left")
    px = F.col("ar") * F.col("sx") - F.col("ai") * F.col("sy") + F.col("br")
    py = F.col("ar") * F.col("sy") + F.col("ai") * F.col("sx") + F.col("bi")
    return j.withColumns({"px": px, "py": py}).withColumn("residual", F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))).drop("sx", "sy", "ar", "ai", "br", "bi")


def body_length(points: DataFrame) -> DataFrame:
    """session, body: median over frames of the largest distance between two visible parts."""
    seen = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*KEYS).agg(F.collect_list(F.struct("x", "y")).alias("p"))  # a frame's parts, a handful
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))))))
    return seen.withColumn("far", far).where("far > 0").groupBy("session").agg(F.percentile("far", 0.5).alias("body"))


def drop_mistracks(points: DataFrame, shape: DataFrame, rounds: int = 3, most_bodies: float = 0.35) -> DataFrame:
    """Nulls, one a frame and round, the part farthest from its place if that is over most_bodies body lengths and twice the median of the others, and two parts remain."""
    body = body_length(points)
    out = points
    for _ in range(rounds):
        r = residuals(out, shape).join(body, "session", "left")
        w = Window.partitionBy(*KEYS)
        worst = F.max(F.struct("residual", "part")).over(w)
        others = F.percentile(F.when(F.col("part") != F.col("worst.part"), F.col("residual")), 0.5).over(w)
        r = r.withColumn("worst", worst).withColumn("others", others)
        bad = (F.col("part") == F.col("worst.part")) & (F.col("residual") > most_bodies * F.col("body")) & (F.col("residual") > 2 * F.coalesce("others", F.lit(0.0))) & (F.col("n") >= 3)
        bad = F.coalesce(bad, F.lit(False))
        out = r.select(*(F.when(~bad, F.col(c)).alias(c) if c in ("x", "y") else F.col(c) for c in points.columns))
    return out


def place_missing(points: DataFrame, shape: DataFrame, least: int = 3) -> DataFrame:
    """points with missing parts put where the fit of at least ``least`` visible ones has them, and placed (boolean)."""
    r = residuals(points, shape)
    placed = F.coalesce(F.col("x").isNull() & F.col("px").isNotNull() & (F.col("n") >= least), F.lit(False))
    return r.select(*(F.when(placed, F.col(f"p{c}")).otherwise(F.col(c)).alias(c) if c in ("x", "y") else F.col(c) for c in points.columns), placed.alias("placed"))


def wide(points: DataFrame, parts: list[str]) -> DataFrame:
    """session, frame and x, y of each part as columns."""
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}")
    return points.groupBy(*KEYS).agg(*(pick(p, c) for p in parts for c in ("x", "y")))


def side_evidence(frames: DataFrame, front: str, back: str, left: str, right: str, least_axis: float = 0.25, least_offset: float = 0.04) -> DataFrame:
    """Wide frames with evidence in [-1, 1]: positive where ``left`` lies on the left of the back-to-front axis, 0 where a frame can't tell."""
    v = lambda p, c: F.col(f"{p}_{c}")
    ax, ay = v(front, "x") - v(back, "x"), v(front, "y") - v(back, "y")
    d = frames.withColumn("axis", F.sqrt(ax * ax + ay * ay))
    d = d.withColumn("median_axis", F.percentile("axis", 0.5).over(Window.partitionBy("session")))
    across = ((v(left, "y") - v(right, "y")) * ax - (v(left, "x") - v(right, "x")) * ay) / F.when(F.col("axis") > 0, F.col("axis"))
    clear = (F.col("axis") >= least_axis * F.col("median_axis")) & (F.abs(across) >= least_offset * F.col("median_axis"))
    strength = F.least(F.abs(across) / (0.5 * F.col("median_axis")), F.lit(1.0))
    return d.withColumn("evidence", F.coalesce(F.when(clear & (F.col("median_axis") > 0), F.signum(across) * strength), F.lit(0.0))).drop("axis", "median_axis")


def swap_fraction(frames: DataFrame, least_judged: int = 10) -> DataFrame:
    """session, judged, swapped: share of judged frames whose evidence is negative; null below least_judged."""
    judged = F.count(F.when(F.col("evidence") != 0, 1))
    return frames.groupBy("session").agg(judged.alias("judged"), F.when(judged >= least_judged, F.count(F.when(F.col("evidence") < 0, 1)) / judged).alias("swapped"))


def swap_method(swapped: Column, threshold: float = 0.4) -> Column:
    return F.when(swapped >= threshold, "anatomical").otherwise("shape")
