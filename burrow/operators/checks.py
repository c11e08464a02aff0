"""What must hold for any recording, whatever is in it: its parts add up to the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.operators import bins, series
from burrow.operators.measures import NO_ZONE
from burrow.operators.series import SESSION


def identities(df: DataFrame, width_us: int = 60_000_000, count: int = 3, edges_us: tuple[int, ...] = (120_000_000,), zone: str = "zone", tolerance: float = 1e-6) -> DataFrame:
    """session, check, expected, actual, ok of each session's identities, from frames with t_us and x, y.

    duration: intervals sum to the time from the first to the last frame. For bins of a width, of a count and by edges: their distances and their
    times in zones sum to the session's. zone_distance and zone_time: never more than the whole. mean_speed: distance over duration, as a
    mean of speeds weighted by time gives it. Sums may differ by ``tolerance`` of the whole.
    """
    d = series.elapsed(series.steps(series.intervals(df)))
    inside = F.col(zone).isNotNull() & ~F.col(zone).isin(*NO_ZONE)
    forms = {"width": bins.fixed(d, width_us), "count": bins.by_count(d, count), "edges": bins.by_edges(d, list(edges_us))}
    whole = d.groupBy(SESSION).agg(
        (F.max("t_us") - F.min("t_us")).cast("double").alias("span"), F.sum("dt_us").cast("double").alias("time"), F.sum("step").alias("path"), F.sum(F.when(inside, F.col("dt_us")).otherwise(0)).cast("double").alias("zoned"), F.sum(F.when(inside, F.col("step")).otherwise(0.0)).alias("zoned_path"),
        F.sum(F.col("speed") * F.col("dt_us")).alias("speeds"),
    )
    out = whole
    for name, b in forms.items():
        parts = b.groupBy(SESSION, "bin").agg(F.sum("step").alias("p"), F.sum(F.when(inside, F.col("dt_us")).otherwise(0)).alias("z"))
        out = out.join(parts.groupBy(SESSION).agg(F.sum("p").alias(f"{name}_path"), F.sum("z").cast("double").alias(f"{name}_zone")), SESSION)
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.lit(1.0))
    row = lambda check, a, b, ok: F.struct(F.lit(check).alias("check"), a.alias("expected"), b.alias("actual"), ok.alias("ok"))
    same = lambda check, a, b: row(check, a, b, near(a, b))
    c: type[Column] = F.col
    mean = lambda total: F.coalesce(total / F.nullif(c("time"), F.lit(0.0)), F.lit(0.0))
    checks = [same("duration", c("span"), c("time"))]
    for name in forms:
        checks += [same(f"{name}_distance", c("path"), c(f"{name}_path")), same(f"{name}_zone_time", c("zoned"), c(f"{name}_zone"))]
    checks += [
        row("zone_distance", c("path"), c("zoned_path"), c("zoned_path") <= c("path") * (1 + tolerance)),
        row("zone_time", c("time"), c("zoned"), c("zoned") <= c("time")),
        # frames without time have no speed, and may have a step
        row("mean_speed", mean(c("path") * 1e6), mean(c("speeds")), mean(c("speeds")) <= mean(c("path") * 1e6) * (1 + tolerance)),
    ]
    return out.select(SESSION, F.explode(F.array(*checks)).alias("c")).select(SESSION, "c.*")
