"""Time bins: half-open, so that they partition a session."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.measures import is_partial, seconds
from burrow.operators.series import SESSION, runs


def bin_spans(duration_s: float, width: float = 0, count: int = 0, edges: tuple[float, ...] = ()) -> list[tuple[float, float]]:
    """Bins of a session: by edges (the last one open to the end), else by count (whole seconds), else by width; none asked, none made."""
    end = float(math.ceil(duration_s))
    if duration_s <= 0:
        return []
    if edges:
        cuts = [0.0, *sorted(float(e) for e in edges if 0 < e < end), end]
    elif count:
        size = math.ceil(duration_s / count)
        cuts = [float(size * i) for i in range(count + 1)]
    elif width:
        cuts = [width * i for i in range(math.ceil(duration_s / width) + 1)]
    else:
        return []
    return [(float(a), float(b)) for a, b in zip(cuts, cuts[1:])]


def bin_label(start: Column, end: Column) -> Column:
    return F.format_string("%d-%ds", start.cast("long"), end.cast("long"))


def ordinal_label(i: Column, count: int) -> Column:
    """bin1of3: the same part of every recording, however long it is."""
    return F.format_string(f"bin%dof{count}", (i + 1).cast("long"))


def span_label(start: Column, end: Column) -> Column:
    """Seconds, whole where they are: 0-60s, 1.5-3s; whole minutes stay seconds."""
    plain = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", v.cast("double")), "0+$", ""))
    return F.concat(plain(start), F.lit("-"), plain(end), F.lit("s"))


def fixed(df: DataFrame, width_us: int, clock: str = "elapsed_us") -> DataFrame:
    """Adds bin, the number of the half-open bin of the given width."""
    return df.withColumn("bin", F.floor(F.col(clock) / width_us))


def by_edges(df: DataFrame, edges_us: list[int], clock: str = "elapsed_us") -> DataFrame:
    """Adds bin for sorted edges; before the first edge is bin 0, from the last on is the last bin."""
    return df.withColumn("bin", sum(((F.col(clock) >= e).cast("int") for e in edges_us), F.lit(0)))


def by_count(df: DataFrame, count: int, clock: str = "elapsed_us") -> DataFrame:
    """Adds bin for ``count`` bins of whole seconds over each session."""
    size = F.ceil(F.ceil(F.max(clock).over(Window.partitionBy(SESSION)) / 1e6) / count)
    return df.withColumn("bin", F.least(F.floor(F.col(clock) / (F.greatest(size, F.lit(1)) * 1_000_000)), F.lit(count - 1)))


def rows(df: DataFrame, width_us: int, dt: str = "dt_us", step: str = "step", clock: str = "elapsed_us") -> DataFrame:
    """session, bin, label, frames, covered_s, path, mean_rate, partial for bins of a fixed width."""
    out = fixed(df, width_us, clock).groupBy(SESSION, "bin").agg(F.count("*").alias("frames"), F.sum(dt).alias("covered"), F.sum(step).alias("path"))
    start, end = F.col("bin") * (width_us / 1e6), (F.col("bin") + 1) * (width_us / 1e6)
    rate = F.when(F.col("covered") > 0, F.col("path") / seconds("covered")).otherwise(0.0)
    return out.select(SESSION, "bin", bin_label(start, end).alias("label"), "frames", seconds("covered").alias("covered_s"), "path", rate.alias("mean_rate"), is_partial(F.col("covered"), F.lit(width_us)).alias("partial"))


def zone_entries(df: DataFrame, zone: str, width_us: int, least_us: int, dt: str = "dt_us", clock: str = "elapsed_us") -> DataFrame:
    """session, bin, zone, total_us, entries: runs of a zone are cut at bin borders before they are counted."""
    binned = runs(fixed(df, width_us, clock), F.struct(zone, "bin"), "run")
    s = binned.groupBy(SESSION, "run", "bin", zone).agg(F.sum(dt).alias("time_us"), F.count("*").alias("frames"))
    counts = (F.col("time_us") >= least_us - 0.001) & (F.col("frames") >= 2)
    return s.groupBy(SESSION, "bin", zone).agg(F.sum("time_us").alias("total_us"), F.count(F.when(counts, 1)).alias("entries"))


def per_state(df: DataFrame, state: str, width_us: int, dt: str = "dt_us", clock: str = "t_us") -> DataFrame:
    """session, state, bin, total_us: bins counted from the first frame of each state."""
    first = F.min(clock).over(Window.partitionBy(SESSION, state))
    return df.where(F.col(state).isNotNull()).withColumn("bin", F.floor((F.col(clock) - first) / width_us)).groupBy(SESSION, state, "bin").agg(F.sum(dt).alias("total_us"))
