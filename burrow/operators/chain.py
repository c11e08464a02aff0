"""Whole chains from raw keypoints to a cleaned pose or one track: swaps, gates, repair across parts, smoothing, clamps.

Long points (session, frame, t_us, part, x, y, conf) go in; what each step does is in ``clean`` and ``repair``. Per-part series are
keyed by (session, part), so a session's parts are cleaned side by side, and the two axes of the smoother share one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators import clean, repair, series

SERIES = ("session", "part")
#: Fixed value: the confidence of a placed part.
PLACED = 0.15


@dataclass(frozen=True)
class Chain:
    """Parameters, with their defaults. axis: front and back part; pairs: mirror parts; ends: head and body part that a detector may exchange."""

    parts: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...] = ()
    axis: tuple[str, str] | None = None
    ends: tuple[str, str] | None = None
    swap_correct: bool = True
    swap_cost_threshold: float = 0.3
    pcut: float = 0.55
    refine: bool = True
    percentile: float = 5
    floor: float = 0.1
    ceiling: float = 0.6
    jump_spreads: float = 6
    most_gap_us: int = 250_000
    repair: bool = True
    method: str = "auto"
    smoother: str = "rts"
    measure_px: float = 2.0
    max_speed: float = 380.0
    rolling_median: bool = False
    smooth: bool = True
    min_cutoff: float = 1.0
    beta: float = 0.007
    body_part: str = ""
    px_per_cm: float = 0.0
    min_move: float = 0.0

    def places(self, names: tuple[str, str]) -> tuple[int, int]:
        return self.parts.index(names[0]), self.parts.index(names[1])


def _at(i: int | Column) -> tuple[Column, Column]:
    i = F.lit(i) if isinstance(i, int) else i
    return F.get("x", i), F.get("y", i)


def swap_anchors(frames: DataFrame, parts: int, ends: tuple[int, int], least_frames: int = 20, least_ratio: float = 1.25) -> DataFrame:
    """session, anchor, head_farther: the part whose usual distances to head and body differ most, if they differ by ``least_ratio``."""
    gap = lambda a, b: F.sqrt(F.pow(_at(a)[0] - _at(b)[0], 2) + F.pow(_at(a)[1] - _at(b)[1], 2))
    others = [i for i in range(parts) if i not in ends]
    if not others:
        return frames.select("session", F.lit(None).cast("int").alias("anchor"), F.lit(None).cast("boolean").alias("head_farther")).distinct()
    d = frames.select("session", *(F.when(gap(ends[1 - k], i).isNotNull(), gap(ends[k], i)).alias(f"d{k}_{i}") for i in others for k in (0, 1)))
    d = d.groupBy("session").agg(*(F.percentile(f"d{k}_{i}", 0.5).alias(f"m{k}_{i}") for i in others for k in (0, 1)), *(F.count(f"d0_{i}").alias(f"n_{i}") for i in others))
    told = []
    for i in others:
        h, b = F.col(f"m0_{i}"), F.col(f"m1_{i}")
        ratio = F.greatest(h, b) / F.least(h, b)
        told.append(F.when((F.col(f"n_{i}") >= least_frames) & (F.least(h, b) > 0) & (ratio >= least_ratio), F.struct(ratio.alias("ratio"), F.lit(-i).alias("i"), (h > b).alias("far"))))
    best = F.array_max(F.array_compact(F.array(*told)))
    return d.select("session", (-best["i"]).cast("int").alias("anchor"), best["far"].alias("head_farther"))


def ends_resolved(frames: DataFrame, how: Chain) -> DataFrame:
    """Frames whose head and body are exchanged, confidence and all, while a detector has their names crossed; with crossed."""
    h, b = how.places(how.ends)
    d = frames.join(swap_anchors(frames, len(how.parts), (h, b)), "session", "left")
    d = d.withColumns(dict(zip(("ax", "ay", "bx", "by", "anx", "any_"), (*_at(h), *_at(b), *_at(F.col("anchor"))))))
    d = clean.crossed_pairs(d, how.swap_cost_threshold, ("anx", "any_"), "head_farther")
    turn = lambda c: F.transform(c, lambda v, i: F.when(F.col("crossed") & (i == h), F.get(c, F.lit(b))).when(F.col("crossed") & (i == b), F.get(c, F.lit(h))).otherwise(v))
    return d.withColumns({c: turn(c) for c in ("x", "y", "conf")}).select("session", "frame", "t_us", "x", "y", "conf", "crossed")


def refined_parts(points: DataFrame, how: Chain) -> DataFrame:
    """Points cleaned along each part (own confidence gate, jumps, short gaps), then across parts, then smoothed; with filled."""
    if not how.refine:
        return points.withColumn("filled", F.lit(False))
    p = clean.part_gate(points, how.percentile, how.floor, how.ceiling, keys=SERIES)
    p = clean.jump_gate(p, how.jump_spreads, keys=SERIES)
    p = clean.fill_gaps(p, how.most_gap_us, "t_us", "x", "y", parts=("part",))
    if how.repair:
        frames = repair.framed(p, list(how.parts))
        done = repair.repaired(frames, len(how.parts), [how.places(x) for x in how.pairs], how.places(how.axis) if how.axis else None, how.method)
        p = repair.pointed(done, list(how.parts), "filled")
    else:
        p = p.withColumn("filled", F.lit(False))
    if how.smoother == "none":
        return p
    dt = F.col("t_us") - F.lag("t_us").over(series.along("part"))
    p = p.withColumn("dt_us", F.coalesce(dt, F.lit(0)))
    if how.smoother == "savgol":
        for c in ("x", "y"):
            p = clean.zero_lag(p, c, parts=("part",))
        return p.drop("dt_us")
    p = clean.process_variance(p, "x", "y", how.measure_px, keys=SERIES).withColumn("trust", F.when(F.col("filled"), F.lit(PLACED)).otherwise(F.col("conf")))
    few = F.count("*").over(Window.partitionBy(*SERIES)) < 3
    p = p.withColumn("few", few)
    p = clean.rts(p, "x", "smooth_x", how.measure_px, "trust", keys=SERIES)
    p = clean.rts(p, "y", "smooth_y", how.measure_px, "trust", keys=SERIES, dealt=True)
    p = p.withColumns({c: F.when(F.col("few"), F.col(c)).otherwise(F.col(f"smooth_{c}")) for c in ("x", "y")})
    return p.select("session", "frame", "t_us", "part", "x", "y", "conf", "filled")


def _gated(points: DataFrame, how: Chain) -> DataFrame:
    """Points after the exchange of head and body and the first gate."""
    if how.swap_correct and how.ends:
        frames = ends_resolved(repair.framed(points, list(how.parts)), how)
        points = repair.pointed(frames, list(how.parts))
    return clean.gate(points, how.pcut)


def _usual_step(df: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
    """df with dt_us, where the clock jumps back the session's median step."""
    return series.reset_safe_intervals(df) if not parts else df.withColumn("dt_us", F.coalesce(F.col("t_us") - F.lag("t_us").over(series.along(*parts)), F.lit(0)))


def corrected_points(points: DataFrame, how: Chain) -> DataFrame:
    """Every part as it can be written out: exchange, gate, held clamp, median, then the same cleaning that a track is measured through; with filled."""
    p = _usual_step(_gated(points, how), ("part",))
    scale = how.px_per_cm if how.px_per_cm > 0 else 1.0
    p = clean.teleport_gate(p, how.max_speed * scale, parts=("part",), hold=True).drop("dt_us")
    p = p.withColumn("conf", F.when(F.col("conf") >= how.pcut, F.col("conf")))
    if how.rolling_median:
        for c in ("x", "y"):
            p = clean.rolling_median(p, c, f"m{c}", parts=("part",)).withColumn(c, F.col(f"m{c}")).drop(f"m{c}")
    return refined_parts(p, how)


def built_track(points: DataFrame, how: Chain) -> DataFrame:
    """session, frame, t_us, dt_us, x, y, step, speed: one followed point per frame, in cm where px_per_cm is known.

    Exchange, gate, cleaning, the followed part or the mean of all parts that are there, teleports dropped, median and One-Euro.
    """
    p = refined_parts(_gated(points, how), how)
    if how.body_part in how.parts:
        one = p.where(F.col("part") == how.body_part).select("session", "frame", "t_us", "x", "y")
    else:
        one = p.groupBy("session", "frame", "t_us").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    scale = how.px_per_cm if how.px_per_cm > 0 else 1.0
    d = clean.teleport_gate(_usual_step(one), how.max_speed * scale)
    if how.rolling_median:
        for c in ("x", "y"):
            d = clean.rolling_median(d, c, f"m{c}").withColumn(c, F.col(f"m{c}")).drop(f"m{c}")
    if how.smooth:
        for c in ("x", "y"):
            d = clean.one_euro(d, c, f"s{c}", how.min_cutoff, how.beta, dealt=c == "y")
        d = d.withColumns({c: F.col(f"s{c}") for c in ("x", "y")}).drop("sx", "sy")
    w = series.along()
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / scale
    step = F.coalesce(F.when(far >= how.min_move, far), F.lit(0.0))
    d = d.withColumn("step", step).withColumn("speed", F.when(F.col("dt_us") > 0, F.col("step") * 1e6 / F.col("dt_us")).otherwise(0.0))
    return d.select("session", "frame", "t_us", "dt_us", "x", "y", "step", "speed")
