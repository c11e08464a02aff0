"""Result rows of sessions: which spans make a row, what a row holds, and time bins beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.functions.names import rounded
from burrow.operators.measures import NO_ZONE, preference, still_bouts
from burrow.operators.series import SESSION, along


@dataclass(frozen=True)
class Flags:
    """Which groups of columns a row has."""

    locomotion: bool = True
    transitions: bool = True
    zone_time: bool = True
    zone_entries: bool = True
    zone_distance: bool = True


def locomotion(px_per_cm: float | None, path: Column, seconds: Column, peak: Column, prefix: str = "") -> dict[str, Column]:
    """Distance, mean and peak speed: metres where the recording is calibrated, else pixels."""
    unit, scale = ("m", 100.0 * px_per_cm) if px_per_cm else ("px", 1.0)
    mean = F.when(seconds > 0, path / seconds).otherwise(0.0)
    return {f"{prefix}Distance_{unit}": path / scale, f"{prefix}Mean_Speed_{unit}_s": mean / scale, f"{prefix}Max_Speed_{unit}_s": F.coalesce(peak, F.lit(0.0)) / scale}


def shaped(df: DataFrame, stage: str = "stage", split: bool = True, least_frames: int = 2) -> DataFrame:
    """df with span (0 for a whole session) and Stage: the rows' frames.

    A session with two named stage spans or more is split into those of at least ``least_frames`` frames; frames of others
    go. If none is long enough, or with fewer named spans, the session is one row without a stage of its own.
    """
    w, own = along(), Window.partitionBy(SESSION)
    turned = F.coalesce((~F.col(stage).eqNullSafe(F.lag(stage).over(w))).cast("int"), F.lit(1))
    d = df.withColumn("span", F.sum(turned).over(w))
    d = d.withColumn("span_n", F.count("*").over(Window.partitionBy(SESSION, "span")))
    named = F.col(stage).isNotNull() & (F.col(stage) != "")
    first = F.row_number().over(Window.partitionBy(SESSION, "span").orderBy("frame")) == 1
    d = d.withColumn("opens", first & named)
    d = d.withColumns({"named_spans": F.sum(F.col("opens").cast("int")).over(own), "long_spans": F.sum((F.col("opens") & (F.col("span_n") >= least_frames)).cast("int")).over(own)})
    parts = F.lit(split) & (F.col("named_spans") >= 2) & (F.col("long_spans") > 0)
    d = d.where(~parts | (named & (F.col("span_n") >= least_frames)))
    return d.withColumns({"span": F.when(parts, F.col("span")).otherwise(0), "Stage": F.when(parts, F.col(stage)).otherwise("")}).drop("span_n", "opens", "named_spans", "long_spans")


def session_row(df: DataFrame, zones: list[str], flags: Flags = Flags(), px_per_cm: float | None = None, keys: tuple[str, ...] = (SESSION,), has_pose: bool = True) -> DataFrame:
    """One wide row per key from frames with dt_us, step, speed and zone: Duration_s (rounded up), then the groups that flags ask for, floats to 4 decimals.

    Without a pose only what the zone column alone can tell is there: no distances and speeds.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    where = F.when(~F.col("zone").isin(*NO_ZONE), F.col("zone"))
    d = df.withColumn("row_zone", where).withColumn("came_from", F.lag("zone").over(w)).withColumn("last_zone", F.last("row_zone", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seconds = F.sum("dt_us") / 1e6
    columns: dict[str, Column] = {"Duration_s": F.ceil(seconds)}
    if flags.locomotion and has_pose:
        columns |= locomotion(px_per_cm, F.sum("step"), seconds, F.max("speed"))
    if flags.transitions:
        columns["Transitions_total"] = F.count_if(F.col("row_zone") != F.col("last_zone"))
    unit, scale = ("m", 100.0 * px_per_cm) if px_per_cm else ("px", 1.0)
    for z in zones:
        inside = F.coalesce(F.col("zone") == z, F.lit(False))
        if flags.zone_time:
            columns[f"{z}_time_s"] = F.sum(F.when(inside, F.col("dt_us")).otherwise(0)) / 1e6
        if flags.zone_entries:
            columns[f"{z}_entries"] = F.count_if(inside & ~F.coalesce(F.col("came_from") == z, F.lit(False)))
        if flags.zone_distance and has_pose:
            columns[f"{z}_distance_{unit}"] = F.sum(F.when(inside, F.col("step")).otherwise(0.0)) / scale
    return rounded(d.groupBy(*keys).agg(*(c.alias(n) for n, c in columns.items())))


def visited(df: DataFrame, regions: dict[str, list[str]], least_us: int = 200_000, keys: tuple[str, ...] = (SESSION,), dt: str = "dt_us") -> DataFrame:
    """keys, kind (body or head), name, time_us, entries, exits, latency_us, visit_us: of every zone and region that a session's body (zone) or head (head_zone) was in.

    A run counts as a visit once it has lasted least_us on a frame after its first; one still open at the end has no exit; the latency is
    the time to the start of the first visit. A frame in two zones of a region is in the region once. All are found in one pass.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    d = df.withColumns({"place": F.row_number().over(w), "so_far": F.sum(dt).over(w), "places": F.count("*").over(Window.partitionBy(*keys))})
    of = lambda c: F.array_distinct(F.array_compact(F.array(F.when(~F.col(c).isin(*NO_ZONE), F.col(c)), *(F.when(F.col(c).isin(*zs), F.lit(r)) for r, zs in regions.items()))))
    held = F.transform(of("zone"), lambda z: F.struct(F.lit("body").alias("kind"), z.alias("name")))
    if "head_zone" in df.columns:
        held = F.concat(held, F.transform(of("head_zone"), lambda z: F.struct(F.lit("head").alias("kind"), z.alias("name"))))
    rows = d.select(*keys, "place", "places", "so_far", F.col(dt).alias("dt"), F.explode(held).alias("h")).select(*keys, "place", "places", "so_far", "dt", "h.*")
    rows = rows.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*keys, "kind", "name").orderBy("place")))
    runs = rows.groupBy(*keys, "kind", "name", "run").agg(F.sum("dt").alias("us"), F.count("*").alias("n"), F.max("place").alias("last"), F.first("places").alias("places"), F.min(F.col("so_far") - F.col("dt")).alias("start"))
    counts = (F.col("n") >= 2) & (F.col("us") >= least_us - 0.001)
    return runs.groupBy(*keys, "kind", "name").agg(F.sum("us").alias("time_us"), F.count_if(counts).alias("entries"), F.count_if(counts & (F.col("last") < F.col("places"))).alias("exits"), F.min(F.when(counts, F.col("start"))).alias("latency_us"), F.coalesce(F.sum(F.when(counts, F.col("us"))), F.lit(0)).alias("visit_us"))


def detailed_row(df: DataFrame, zones: list[str], regions: dict[str, list[str]] | None = None, px_per_cm: float | None = None, immobile_cm_s: float = 2.0, freeze_cm_s: float = 0.5, least_still_us: int = 1_000_000, least_us: int = 200_000, novel: str = "", familiar: str = "") -> DataFrame:
    """One wide row per session beside ``session_row``'s: bouts of immobility and freezing, visits of zones and regions by body and head, and preference.

    Immobile_time_s, Immobile_bouts, Freezing_time_s, Freezing_episodes, Freezing_latency_s; for each zone and region name_entries, name_exits, name_latency_s, name_mean_visit_s and
    name_time_s, with a head_zone also name_time_head_s and name_entries_head; with a novel or familiar zone Preference and Preference_pct. Floats to 4 decimals.
    """
    scale, regions = px_per_cm or 1.0, regions or {}
    still = still_bouts(df, "speed", immobile_cm_s * scale, least_still_us).select(SESSION, (F.col("still_us") / 1e6).alias("Immobile_time_s"), F.col("bouts").alias("Immobile_bouts"))
    froze = still_bouts(df, "speed", freeze_cm_s * scale, least_still_us).select(SESSION, (F.col("still_us") / 1e6).alias("Freezing_time_s"), F.col("bouts").alias("Freezing_episodes"), (F.col("latency_us") / 1e6).alias("Freezing_latency_s"))
    v = visited(df, regions, least_us)
    pick = lambda n, k, c: F.max(F.when((F.col("name") == n) & (F.col("kind") == k), F.col(c)))
    no = lambda c: F.coalesce(c, F.lit(0))
    cells = []
    for n in [*zones, *regions]:
        visits = pick(n, "body", "entries")
        cells += [(no(pick(n, "body", "time_us")) / 1e6).alias(f"{n}_time_s"), no(visits).alias(f"{n}_entries"), no(pick(n, "body", "exits")).alias(f"{n}_exits"), (pick(n, "body", "latency_us") / 1e6).alias(f"{n}_latency_s"), no(pick(n, "body", "visit_us") / F.nullif(visits, F.lit(0)) / 1e6).alias(f"{n}_mean_visit_s")]
        if "head_zone" in df.columns:
            cells += [(no(pick(n, "head", "time_us")) / 1e6).alias(f"{n}_time_head_s"), no(pick(n, "head", "entries")).alias(f"{n}_entries_head")]
    out = still.join(froze, SESSION)
    if cells:
        out = out.join(v.groupBy(SESSION).agg(*cells), SESSION, "left")
    if novel or familiar:
        chosen = preference(df, "zone", novel, familiar).select(SESSION, F.col("preference").alias("Preference"), F.col("percent").alias("Preference_pct"))
        out = out.join(chosen, SESSION, "left")
    zero = [f"{n}_{c}" for n in [*zones, *regions] for c in ("time_s", "entries", "exits", "mean_visit_s", "time_head_s", "entries_head") if f"{n}_{c}" in out.columns]
    return rounded(out.fillna(0, zero) if zero else out)


def with_bins(rows: DataFrame, bins: DataFrame, labels: list[str], values: list[str], keys: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """rows with the columns ``label_value`` of their bins (keys, label, values) beside them; rows without a bin have null there."""
    wide = bins.groupBy(*keys).agg(*(F.max(F.when(F.col("label") == b, F.col(v))).alias(f"{b}_{v}") for b in labels for v in values))
    return rows.join(wide, list(keys), "left")


def sliced(df: DataFrame, lo: int, hi: int, clock: str = "t_us") -> DataFrame:
    """The frames lo to hi - 1 of each session, counted from 0, with intervals of their own: the first frame's is 0."""
    d = df.withColumn("place", F.row_number().over(along()) - 1).where((F.col("place") >= lo) & (F.col("place") < hi)).drop("place")
    return d.withColumn("dt_us", F.coalesce(F.col(clock) - F.lag(clock).over(along()), F.lit(0)))


def unwrapped(df: DataFrame, clock: str = "t_us") -> DataFrame:
    """df with t_adj and dt_us: after a step back the clock goes on from where it was by the session's median positive step (0 if there is none)."""
    w = along()
    step = F.col(clock) - F.lag(clock).over(w)
    d = df.withColumn("raw_step", step)
    median = F.coalesce(F.percentile(F.when(F.col("raw_step") > 0, F.col("raw_step")), 0.5).over(Window.partitionBy(SESSION)), F.lit(0.0))
    d = d.withColumn("median_step", median).withColumn("added", F.sum(F.when(F.col("raw_step") < 0, F.col("median_step") - F.col("raw_step")).otherwise(0.0)).over(w))
    d = d.withColumn("t_adj", F.col(clock) + F.col("added"))
    return d.withColumn("dt_us", F.when(F.col("raw_step") < 0, F.col("median_step")).otherwise(F.coalesce(F.col("raw_step"), F.lit(0)).cast("double"))).drop("raw_step", "median_step", "added")


def looked_up(frames: DataFrame, tables: dict[str, DataFrame], keys: tuple[str, ...] = (SESSION, "frame")) -> DataFrame:
    """frames with one more column for each table (keys and that column); frames that it lacks get null."""
    for name, t in tables.items():
        frames = frames.join(t.select(*keys, name), list(keys), "left")
    return frames


def nearest_file(wanted: DataFrame, files: DataFrame, siblings: tuple[str, ...] = ("", "temp", "mcu"), up: int = 2) -> DataFrame:
    """folder, stem, found, tier: for each wanted stem the file of that name in its folder, the folders above it up to ``up`` levels and their siblings, nearest first.

    Where none is there, the file of that name anywhere below the wanted row's project, if there is just that one to take: the smallest path.
    wanted has folder, stem and project, files has path; folders are parted by slashes.
    """
    # all of these grow with the recordings, and paths of one pattern look small in compressed files: none is gathered on the driver to be broadcast
    merged = lambda d: d.hint("merge")
    f = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("at"), F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "").alias("stem"))
    above = [F.regexp_replace("folder", f"(?:/[^/]+){{{n}}}$", "") for n in range(up + 1)]
    looks = [F.struct(F.lit(n * len(siblings) + k).alias("tier"), F.when(F.lit(s == ""), a).otherwise(F.concat(a, F.lit("/" + s))).alias("at")) for n, a in enumerate(above) for k, s in enumerate(siblings)]
    near = wanted.select("folder", "stem", F.explode(F.array(*looks)).alias("look")).select("folder", "stem", "look.tier", "look.at").join(merged(f), ["at", "stem"])
    near = near.groupBy("folder", "stem").agg(F.min(F.struct("tier", "path")).alias("best"))
    # of a stem's files only the smallest path below each folder counts, so files named alike make no pairs
    parts = F.split("at", "/")
    below = f.join(merged(wanted.select("stem").distinct()), "stem").select("stem", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    below = below.groupBy("stem", "root").agg(F.min("path").alias("far"))
    far = wanted.select("folder", "stem", F.rtrim("project", F.lit("/")).alias("root")).distinct().join(merged(below), ["stem", "root"]).groupBy("folder", "stem").agg(F.min("far").alias("far"))
    j = wanted.select("folder", "stem").distinct().join(merged(near), ["folder", "stem"], "left").join(merged(far), ["folder", "stem"], "left")
    return j.select("folder", "stem", F.coalesce("best.path", "far").alias("found"), F.coalesce("best.tier", F.when(F.col("far").isNotNull(), F.lit(len(looks)))).alias("tier"))


def count_check(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """session, rows, frames, diff, percent: recordings whose number of rows isn't their video's number of frames; unknown videos pass."""
    n = rows.groupBy(SESSION).agg(F.count("*").alias("rows"))
    j = n.join(videos.where("frames > 0"), SESSION).withColumn("diff", F.col("frames") - F.col("rows"))
    return j.where("diff <> 0").withColumn("percent", F.round(F.abs("diff") / F.col("frames") * 100, 4))


def agrees(parity: DataFrame, mean: float = 0.25, p95: float = 1.0, most: float = 8.0, overlap: float = 0.5) -> DataFrame:
    """A comparison of two runs (``joins.parity``) with overlap and whether it is within the thresholds."""
    shared = F.col("shared") / F.greatest(F.col("shared") + F.greatest("only_a", "only_b"), F.lit(1))
    within = (shared >= overlap) & (F.col("mean_px") <= mean) & (F.col("p95_px") <= p95) & (F.col("max_px") <= most)
    return parity.withColumns({"overlap": F.round(shared, 6), "agrees": F.coalesce(within, F.lit(False))})


def canonical_zone(located: DataFrame, recorded: str, found: str = "zone", out: str = "body_zone") -> DataFrame:
    """located with one zone for the body: the one its position is in, else the recorded one; absent words are no zone."""
    logged = F.when(~F.col(recorded).isin(*NO_ZONE), F.col(recorded))
    return located.withColumn(out, F.coalesce(F.col(found), logged))


def distinct_paths(files: DataFrame, order: str = "ord") -> DataFrame:
    """path, ord: each path once, at the place where it first came; repeated and closing slashes don't make another path."""
    plain = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "(?<=.)/$", "")
    return files.select(plain.alias("path"), order).groupBy("path").agg(F.min(order).alias(order))
