"""Measures of whole tracks: trailing means, recent history, line points, and what a recording's clock, frame and scale are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.functions.geometry import in_polygon
from burrow.functions.scalars import is_absent
from burrow.operators.series import FRAME, SESSION, along, runs


def _whole():
    return Window.partitionBy(SESSION)


def trailing_mean(df: DataFrame, value: str, out: str, n: int) -> DataFrame:
    """Mean of up to n values, the frame's own included; fewer at a session's start."""
    return df.withColumn(out, F.avg(value).over(along().rowsBetween(-(n - 1), 0)))


def trimmed(df: DataFrame, lo: int, hi: int, clock: str = "t_us") -> DataFrame:
    """Frames from lo to hi after the session's start, both ends included."""
    since = F.col(clock) - F.min(clock).over(_whole())
    return df.withColumn("since", since).where((F.col("since") >= lo) & (F.col("since") <= hi)).drop("since")


def recent(df: DataFrame, active: Column, width: int, clock: str = "t_us") -> DataFrame:
    """recent_n, recent_active: samples, and active ones, of the time ``width`` up to each frame, both ends included."""
    w = Window.partitionBy(SESSION).orderBy(clock).rangeBetween(-width, 0)
    return df.withColumns({"recent_n": F.count("*").over(w), "recent_active": F.count(F.when(active, 1)).over(w)})


def active_spans(df: DataFrame, active: Column, clock: str = "t_us") -> DataFrame:
    """session, start, end of each stretch in which ``active`` holds; it ends at the first sample without it, or with the session."""
    marked = runs(df.withColumn("on", F.coalesce(active, F.lit(False))), "on").withColumn("until", F.coalesce(F.lead(clock).over(along()), F.col(clock)))
    return marked.where("on").groupBy(SESSION, "run").agg(F.min(clock).alias("start"), F.max("until").alias("end")).drop("run")


def history_points(df: DataFrame, value: str, trials: str | None = None) -> DataFrame:
    """Rows at which a drawn line gains a point: where the trial count passes all earlier ones; without a count, where the value changes."""
    w = along()
    if trials is None:
        new = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    else:
        new = F.col(trials) > F.coalesce(F.max(trials).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("new_point", new).where("new_point").drop("new_point")


def state_clock(df: DataFrame, state: str, dt: str = "dt_us", out: str = "state_us") -> DataFrame:
    """Time spent in the frame's state so far, with intervals of the whole session carried; 0 on the state's first frame."""
    w = along(state).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(dt).over(w) - F.first(dt).over(w))


def evenly_spaced(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` frames of each session, evenly spaced, the first and the last among them."""
    n, i = F.count("*").over(_whole()), F.row_number().over(along()) - 1
    d = df.withColumns({"n_all": n, "i_all": i})
    step = (F.col("n_all") - 1) / F.lit(float(max(most - 1, 1)))
    # a place i is taken if some j has floor(j * step) = i: the smallest j with j * step >= i must stay below i + 1
    taken = F.ceil(F.col("i_all") / step) * step < F.col("i_all") + 1
    return d.where((F.col("n_all") <= most) | F.coalesce(taken, F.lit(False))).drop("n_all", "i_all")


def session_clock(df: DataFrame, clocks: list[str], fps: float = 30.0, out: str = "clock_ms") -> DataFrame:
    """The first of the clock columns that a session has any value of, carried forward over its gaps (0 before the first); else frame / fps.

    One column serves a whole session, so clocks never mix within it.
    """
    usable = lambda c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c).cast("double"))
    picked, source = F.col(FRAME) / F.lit(fps) * 1000.0, F.lit("index")
    for c in reversed(clocks):
        has = F.count(usable(c)).over(_whole()) > 0
        picked, source = F.when(has, usable(c)).otherwise(picked), F.when(has, F.lit(c)).otherwise(source)
    d = df.withColumns({"clock_raw": picked, "clock_source": source})
    return d.withColumn(out, F.coalesce(F.last("clock_raw", ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).drop("clock_raw")


def fits_frame(points: DataFrame, width: float, height: float, tolerance: float = 0.02, x: str = "x", y: str = "y") -> DataFrame:
    """session, outside, fits: whether the points lie in the frame but for a few; a session without points fits."""
    far = (F.col(x) < -1) | (F.col(x) > width + 1) | (F.col(y) < -1) | (F.col(y) > height + 1)
    outside = F.avg(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), far.cast("double")))
    return points.groupBy(SESSION).agg(outside.alias("outside")).withColumn("fits", F.coalesce(F.col("outside") <= tolerance, F.lit(True)))


#: Points that all scales are tried on at once, whatever a batch holds.
TRIED = 1024


def _tried_scales(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """session, k, hits, scored: of some of a batch's points, how many lie in their polygon under each of 201 scales."""
    for b in batches:
        if b.num_rows:
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable")))
        for start in range(0, b.num_rows, TRIED):
            yield _tried(b.slice(start, TRIED))


def _tried(b: pa.RecordBatch) -> pa.RecordBatch:
    """``_tried_scales`` of points in the order of their sessions."""
    session, lo, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3))
    # halves are rounded up, as SQL does; numpy would round them to the even neighbour
    cents = (lo[:, None] + np.arange(201) / 100) * 100
    k = (np.trunc(cents) + (cents - np.trunc(cents) >= 0.5)) / 100
    held = np.zeros(k.shape, bool)
    shapes: dict[tuple, list[int]] = {}
    for i, p in enumerate(b.column(4).to_pylist()):
        shapes.setdefault(tuple((q["x"], q["y"]) for q in p or ()), []).append(i)
    for corners, rows in shapes.items():
        if len(corners) < 3:
            continue
        px, py = x[rows, None] / k[rows], y[rows, None] / k[rows]
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            if ay != by:
                held[rows] ^= ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))
    own, first = np.unique(session, return_index=True)
    hits = np.add.reduceat(held, first, axis=0, dtype=np.int64)
    counts = np.repeat(np.diff([*first, len(session)]), 201)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, 201)), pa.array(k[first].ravel()), pa.array(hits.ravel()), pa.array(counts)], names=["session", "k", "hits", "scored"])


def frame_scale(points: DataFrame, zones: DataFrame, width: float, height: float, zone: str = "zone", least: int = 20, accept: float = 0.8) -> DataFrame:
    """session, scale: by how much the points' frame is larger than the declared one; null without evidence.

    ``zones`` (name, points in shares of the frame) is a handful of rows. 201 scales from the smallest that
    holds all points are tried against the zone that each frame recorded; the first with the
    most agreement wins if that reaches ``accept``. Tries are summed by session before the shuffle.
    """
    seen = points.where("x IS NOT NULL AND y IS NOT NULL")
    reach = fits_frame(seen, width, height).join(seen.groupBy(SESSION).agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.max("x") / width, F.max("y") / height).alias("lo")), SESSION)
    open_ = reach.where((F.col("n") >= least) & ~F.col("fits"))
    named = seen.where(~is_absent(F.col(zone)) & (F.trim(zone) != "-")).join(zones.select(F.col("name").alias(zone), F.col("points").alias("polygon")), zone, "left")
    tried = named.join(open_.select(SESSION, "lo"), SESSION).select(SESSION, "lo", (F.col("x") / width).alias("x"), (F.col("y") / height).alias("y"), "polygon")
    sums = tried.mapInArrow(_tried_scales, f"session {dict(tried.dtypes)[SESSION]}, k double, hits long, scored long").groupBy(SESSION, "k").agg(F.sum("hits").alias("hits"), F.sum("scored").alias("scored"))
    share = F.col("hits") / F.col("scored")
    best = sums.where(F.col("scored") >= least).groupBy(SESSION).agg(F.max_by("k", F.struct(share, -F.col("k"))).alias("k"), F.max(share).alias("share"))
    out = reach.join(best, SESSION, "left")
    return out.select(SESSION, F.when(F.col("n") < least, F.lit(None)).when(F.col("fits"), F.lit(1.0)).when(F.col("share") >= accept, F.col("k")).alias("scale"))


def tracker_quality(df: DataFrame, x: str = "x", y: str = "y", area: str = "area", ring: int = 120, jitter_ring: int = 30) -> DataFrame:
    """session, frames, success_rate, jitter, area_median, area_p10, area_p90 over each session's last frames.

    Success and areas look at the last ``ring`` frames and areas, jitter at the last ``jitter_ring`` located
    frames; percentiles are values of the sorted list, not interpolated.
    """
    back = Window.partitionBy(SESSION).orderBy(F.desc(FRAME))
    found = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.withColumns({"hit": found, "back": F.row_number().over(back)}).withColumn("found_back", F.sum(F.col("hit").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    areas = F.array_sort(F.collect_list(F.when(F.col("hit") & (F.col("found_back") <= ring), F.col(area))))  # at most ring values
    near = lambda c: F.when(F.col("hit") & (F.col("found_back") <= jitter_ring), F.col(c))
    g = d.where((F.col("back") <= ring) | (F.col("found_back") <= ring)).groupBy(SESSION).agg(
        F.count(F.when(F.col("back") <= ring, 1)).alias("frames"),
        F.avg(F.when(F.col("back") <= ring, F.col("hit").cast("double"))).alias("success_rate"),
        F.sqrt(F.var_pop(near(x)) + F.var_pop(near(y))).alias("jitter"),
        areas.alias("areas"),
    )
    n = F.size("areas")
    place = lambda i: F.coalesce(F.get("areas", i), F.lit(0.0))
    return g.select(
        SESSION, "frames", "success_rate", F.coalesce("jitter", F.lit(0.0)).alias("jitter"),
        place(F.floor(n / 2).cast("int")).alias("area_median"),
        place(F.greatest(F.lit(0), F.floor(n * 0.1).cast("int") - 1)).alias("area_p10"),
        place(F.least(n - 1, F.floor(n * 0.9).cast("int"))).alias("area_p90"),
    )


def stage_budget(summary: DataFrame, p95: str = "p95", fallback_ms: float = 33.0, cap_ms: float = 75.0) -> DataFrame:
    """total_ms, horizon_ms: the stages' 95th percentiles added up, and how far ahead to predict."""
    total = F.coalesce(F.sum(p95), F.lit(0.0))
    return summary.agg(total.alias("total_ms")).withColumn("horizon_ms", F.greatest(F.lit(0.0), F.least(F.lit(cap_ms), F.when(F.col("total_ms") > 0, F.col("total_ms")).otherwise(fallback_ms))))


def swap_anchor(wide: DataFrame, head: str, body: str, others: list[str], least: int = 20, least_ratio: float = 1.25) -> DataFrame:
    """session, anchor, head_is_farther, ratio: the part whose median distances to head and body differ most; null if none is decisive.

    ``wide`` has a pair of columns ``<part>_x``, ``<part>_y`` for each part.
    """
    far = lambda a, b: F.sqrt(F.pow(F.col(f"{a}_x") - F.col(f"{b}_x"), 2) + F.pow(F.col(f"{a}_y") - F.col(f"{b}_y"), 2))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("anchor"), far(head, p).alias("dh"), far(body, p).alias("db")) for i, p in enumerate(others)))).alias("d")
    rows = wide.select(SESSION, each).select(SESSION, "d.*").where("dh IS NOT NULL AND db IS NOT NULL")
    m = rows.groupBy(SESSION, "place", "anchor").agg(F.count("*").alias("n"), F.percentile("dh", 0.5).alias("mh"), F.percentile("db", 0.5).alias("mb")).where((F.col("n") >= least) & (F.least("mh", "mb") > 0))
    m = m.withColumn("ratio", F.greatest("mh", "mb") / F.least("mh", "mb"))
    best = m.groupBy(SESSION).agg(F.max_by(F.struct("anchor", (F.col("mh") > F.col("mb")).alias("head_is_farther"), "ratio"), F.struct("ratio", -F.col("place"))).alias("b"))
    return best.select(SESSION, "b.*").where(F.col("ratio") >= least_ratio)


def nested_zones(zones: DataFrame, name: str = "name") -> DataFrame:
    """name, parent, depth, ord: each zone's smallest container, how deep it lies, and its place from the innermost out.

    A zone holds another if all its corners lie inside it and it is larger. ``zones`` (name, points, area) is a handful of rows.
    """
    inner = zones.select(F.col(name).alias("inner"), F.col("points").alias("corners"), F.col("area").alias("inner_area"))
    held = inner.join(zones, (F.col("inner") != F.col(name)) & (F.col("area") > F.col("inner_area")) & F.forall("corners", lambda p: in_polygon(p["x"], p["y"], F.col("points"))))
    parents = held.groupBy("inner").agg(F.min_by(name, F.struct("area", name)).alias("parent"))
    out = zones.select(name).join(parents.withColumnRenamed("inner", name), name, "left")
    # of nested containers each is inside the next, so the depth is the number of containers along the parents
    depth = out.select(name, "parent").withColumn("depth", F.lit(0))
    up = out.select(F.col(name).alias("above"), F.col("parent").alias("next"))
    chain = out.select(name, F.col("parent").alias("at"), F.col("parent").isNotNull().cast("int").alias("depth"))
    while not chain.where("at IS NOT NULL").isEmpty():  # once for each level of nesting
        chain = chain.join(up, chain["at"] == up["above"], "left").select(name, F.col("next").alias("at"), (F.col("depth") + F.col("next").isNotNull().cast("int")).alias("depth"))
    placed = depth.drop("depth").join(chain.select(name, "depth"), name)
    return placed.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("depth"), name)))
