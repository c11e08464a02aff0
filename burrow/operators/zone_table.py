"""The wide zone table: per session, state and bin, time and entries of body and head by region, and confirmed, facing interaction.

Zones are one layout (name, ord, points as an array of x and y), a small table; what derives from it, edges, inner lines and the regions
that hold a point, is one value beside each frame, so frames aren't joined with zones. One window, by (session, state, bin) and frame,
serves the path and the confirmations of all interaction zones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.functions import geometry
from burrow.operators.session_rows import unwrapped
from burrow.operators.zones import located
from burrow.scratch import written

INTERACTION = "_IA"
#: The regions of the table and the zones each one holds.
REGIONS = {
    "CenterZone": ("Social_Buffer", "Social_Open_Corner", "Familiar_Social_Corner", "Open_Buffer", "Open_Novel_Corner", "Novel_Buffer", "Novel_Object1_Corner", "Object1_Buffer", "Object1_Object2_Corner", "Object2_Buffer", "Object2_Familiar_Corner", "Familiar_Buffer"),
    "Center": ("CenterZone",),
    "Social_IA": ("Social_IA",),
    "Social_Entry": ("Social_Entry",),
    "OpenEntry": ("OpenEntry",),
    "OpenArm": ("OpenArm",),
    "NovelArm": ("NovelArm",),
    "Object1_IA": ("Object1_IA",),
    "Object1_Entry": ("Object1_Entry",),
    "Object2_IA": ("Object2_IA",),
    "Object2_Entry": ("Object2_Entry",),
    "FamiliarArm": ("FamiliarArm",),
}
#: The table's columns in their order, texts first.
TEXTS = ("MouseID", "Group", "ExptDate", "StartTime", "subgroup", "State", "Bin")
COLUMNS = (
    *TEXTS, "StateDur_s", "Distance_m", "Max_speed",
    "OpenArm_time_body", "OpenEntry_time_body", "Object1_IA_time_head", "Object2_IA_time_head", "Social_IA_time_head", "FamiliarArm_time_body", "NovelArm_time_body",
    "Object1_IA_entries_head", "Object2_IA_entries_head", "Social_IA_entries_head", "Object1_IA_time_angle", "Object2_IA_time_angle", "Object1_IA-entries_angle", "Object2_IA_entries_angle", "Social_IA_time_angle", "Social_IA_entries_angle",
    "Distance_Center_m", "Distance_NovelArm_m", "Distance_FamiliarArm_m", "Center_entries_body", "Center_time_body", "Center_entries_head", "Center_time_head",
    "Social_IA_entries_body", "Social_IA_time_body", "Social_Entry_entries_body", "Social_Entry_time_body", "Social_Entry_entries_head", "Social_Entry_time_head",
    "OpenEntry_entries_body", "OpenEntry_entries_head", "OpenEntry_time_head", "OpenArm_entries_body", "OpenArm_entries_head", "OpenArm_time_head",
    "NovelArm_entries_body", "NovelArm_entries_head", "NovelArm_time_head", "Object1_IA_entries_body", "Object1_IA_time_body",
    "Object1_Entry_entries_body", "Object1_Entry_time_body", "Object1_Entry_entries_head", "Object1_Entry_time_head",
    "Object2_IA_entries_body", "Object2_IA_time_body", "Object2_Entry_entries_body", "Object2_Entry_time_body", "Object2_Entry_entries_head", "Object2_Entry_time_head",
    "FamiliarArm_entries_body", "FamiliarArm_entries_head", "FamiliarArm_time_head",
)


def _like_the_longest(points: list[tuple[float, float]], cx: float, cy: float, tolerance: float) -> tuple | None:
    """Ends of the edge that is meant by ``outermost_edges``."""
    groups: list[list[tuple]] = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        long = math.hypot(bx - ax, by - ay)
        if long < 1e-6:
            continue
        angle = math.degrees(math.atan2(by - ay, bx - ax)) % 180.0
        edge = (angle, long, math.dist(((ax + bx) / 2, (ay + by) / 2), (cx, cy)), (ax, ay, bx, by))
        like = [g for g in groups if abs(g[0][0] - angle) <= tolerance]
        if like:
            like[0].append(edge)
        else:
            groups.append([edge])
    if not groups:
        return None
    group = max(groups, key=lambda g: max(e[1] for e in g))
    return max(group, key=lambda e: e[2])[3]


def outermost_edges(zones: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """zones (name, ord, points, cx, cy and any columns) with edge (a, b), the legacy outer edge: of those that run like the longest one the one whose middle is farthest from cx, cy.

    Edges join the first group whose first edge's direction (0 to 180 degrees) differs by at most ``tolerance``. Null without an edge that has length.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in zones.dtypes) + ", ends array<double>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("points", "cx", "cy")))
            ends = [_like_the_longest([(p["x"], p["y"]) for p in points or []], cx, cy, tolerance) for points, cx, cy in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.list_(pa.float64()))], names=[*b.schema.names, "ends"])

    end = lambda i: F.struct(F.get("ends", F.lit(i)).alias("x"), F.get("ends", F.lit(i + 1)).alias("y"))
    d = zones.mapInArrow(find, schema)
    return d.withColumn("edge", F.when(F.col("ends").isNotNull(), F.struct(end(0).alias("a"), end(2).alias("b")))).drop("ends")


def tokens(name: Column) -> Column:
    """The words of a zone's name, without the mark of interaction zones."""
    return F.filter(F.split(F.lower(F.replace(name, F.lit("-"), F.lit("_"))), "_"), lambda t: (t != "") & (t != "ia"))


def targets(zones: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, name, target, tx, ty: the zone that an interaction zone is about, and its centre.

    The zone of the same name without the mark; else, of the others that aren't interaction zones, the nearest whose name
    holds all its words, or the nearest; else the zone itself. keys: what tells layouts apart; a layout's zones, a handful, are compared with one another.
    """
    c = geometry.centroid(F.col("points"))
    z = zones.where(F.size("points") >= 3).select(*keys, "name", "ord", c["x"].alias("x"), c["y"].alias("y"))
    ia = z.where(F.col("name").contains(INTERACTION)).withColumn("words", tokens(F.col("name"))).withColumn("plain", F.replace("name", F.lit(INTERACTION), F.lit("")))
    other = z.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("name").alias("other"), F.col("ord").alias("other_ord"), F.col("x").alias("ox"), F.col("y").alias("oy"), tokens(F.col("name")).alias("other_words"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    j = ia.join(other, same)
    plain, self_ = F.col("other") == F.col("plain"), F.col("other") == F.col("name")
    far = F.pow(F.col("ox") - F.col("x"), 2) + F.pow(F.col("oy") - F.col("y"), 2)
    all_words = F.size(F.array_except("words", "other_words")) == 0
    rank = F.when(plain & ~self_, 0).when(self_, 3).when(~F.col("other").contains(INTERACTION), F.when(all_words, 1).otherwise(2))
    best = j.where(rank.isNotNull()).groupBy(*keys, "name").agg(F.min_by(F.struct("other", "ox", "oy"), F.struct(rank, F.when(rank == 0, 0.0).otherwise(far), "other_ord")).alias("b"))
    return best.select(*keys, "name", F.col("b.other").alias("target"), F.col("b.ox").alias("tx"), F.col("b.oy").alias("ty"))


def reference_lines(zones: DataFrame, extend: float = 15.0, inner: float = 50.0, tolerance: float = 15.0) -> DataFrame:
    """name, outer (a, b), on (a point of the inner line), normal of the interaction zones of one layout; the arena's centre is the mean of the zones' centres."""
    c = geometry.centroid(F.col("points"))
    z = zones.where(F.size("points") >= 3).withColumn("c", c)
    cx, cy = (z.agg(F.avg(f"c.{c}")).scalar() for c in "xy")
    z = z.where(F.col("name").contains(INTERACTION)).withColumns({"cx": cx, "cy": cy})
    z = outermost_edges(z.select("name", "ord", "points", "cx", "cy"), tolerance).where("edge IS NOT NULL")
    z = z.withColumn("outer", geometry.extended(F.col("edge.a"), F.col("edge.b"), F.lit(extend)))
    z = z.withColumn("normal", geometry.inward_normal(F.col("outer.a"), F.col("outer.b"), F.col("cx"), F.col("cy")))
    on = F.struct((F.col("outer.a.x") + inner * F.col("normal.x")).alias("x"), (F.col("outer.a.y") + inner * F.col("normal.y")).alias("y"))
    return z.select("name", "ord", "outer", on.alias("on"), "normal")


def confirmed_interaction(df: DataFrame, lines: DataFrame, names: list[str], keys: tuple[str, ...], confirm_ms: float = 100.0, most_deg: float = 45.0) -> DataFrame:
    """df with confirmed_<i>, facing_<i> and entered_<i> for each named interaction zone, in frame order within keys.

    df has t_ms, dt_us, head_zone, hx, hy and x, y. A run of frames with the head in the zone and not past its inner line is confirmed once it has lasted
    ``confirm_ms``; facing are confirmed frames that look at the outer edge within ``most_deg``; a run of these is entered when, after its
    first frame, it has lasted ``confirm_ms`` by the clock.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    listed = lines.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("outer", "on", "normal"))))).scalar()
    d = df.withColumns({"lines": listed, "so_far": F.sum("dt_us").over(w)})
    x, y, hx, hy = (F.col(c) for c in ("x", "y", "hx", "hy"))
    for i, name in enumerate(names):
        z = F.try_element_at("lines", F.lit(name))
        past = (hx - z["on"]["x"]) * z["normal"]["x"] + (hy - z["on"]["y"]) * z["normal"]["y"] <= 0
        d = d.withColumn("near", F.coalesce((F.col("head_zone") == name) & F.coalesce(past, F.lit(True)), F.lit(False)))
        # how long a run has lasted is the time so far without that before its first frame
        d = d.withColumn("since", F.last(F.when(_turns("near", w), F.col("so_far") - F.col("dt_us")), ignorenulls=True).over(w))
        d = d.withColumn(f"confirmed_{i}", F.col("near") & F.coalesce(F.col("so_far") - F.col("since") >= confirm_ms * 1000, F.lit(False))).drop("near", "since")
        a, b = z["outer"]["a"], z["outer"]["b"]
        at = geometry.nearest_on_segment(hx, hy, a["x"], a["y"], b["x"], b["y"])
        angle = geometry.facing(x, y, hx, hy, at["x"], at["y"])
        d = d.withColumn(f"facing_{i}", F.coalesce(F.col(f"confirmed_{i}") & (angle <= most_deg), F.lit(False)))
        d = d.withColumn("first", _turns(f"facing_{i}", w))
        d = d.withColumn("since", F.last(F.when(F.col("first"), F.col("t_ms")), ignorenulls=True).over(w))
        d = d.withColumn("told", F.coalesce(F.col(f"facing_{i}") & ~F.col("first") & (F.col("t_ms") - F.col("since") >= confirm_ms), F.lit(False)))
        d = d.withColumn(f"entered_{i}", _turns("told", w)).drop("told", "first", "since")
    return d.drop("lines", "so_far")


def _turns(flag: str, w) -> Column:
    """Whether a flag turns true here, in a window's order."""
    return F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))


def bin_label(i: Column, seconds: float) -> Column:
    """0-1min for whole minutes, else 0-30s."""
    if seconds >= 60 and seconds % 60 == 0:
        minutes = int(seconds // 60)
        return F.concat((i * minutes).cast("string"), F.lit("-"), ((i + 1) * minutes).cast("string"), F.lit("min"))
    plain = lambda v: F.regexp_replace(F.format_string("%.6f", (v * seconds).cast("double")), r"\.?0+$", "")
    return F.concat(plain(i), F.lit("-"), plain(i + 1), F.lit("s"))


def zone_table(df: DataFrame, zones: DataFrame, names: list[str], m_per_px: float, bin_s: float = 0.0, least_dwell_us: int = 200_000, confirm_ms: float = 100.0, most_deg: float = 45.0, extend: float = 15.0, inner: float = 50.0, tolerance: float = 15.0) -> DataFrame:
    """session and the wide table's columns, a row per session, state and bin; zones outside all regions have columns of their own behind.

    df has session, frame, t_ms, zone, state, x, y, hx, hy, and any of the text columns; names are the layout's zones. Frames without a state aren't in it.
    """
    keys = ("session", "state", "bin")
    d = unwrapped(df.withColumn("t_us", F.col("t_ms") * 1000.0)).withColumn("t_ms", F.col("t_adj") / 1000.0)
    d = located(d.withColumnRenamed("zone", "body_zone"), zones.where(F.size("points") >= 3), "first", "hx", "hy", border=True).withColumnsRenamed({"zone": "head_zone", "body_zone": "zone"}).where("state IS NOT NULL AND state <> ''")
    at = F.floor((F.col("t_ms") - F.min("t_ms").over(Window.partitionBy("session", "state"))) / (bin_s * 1000.0)) if bin_s > 0 else F.lit(0)
    d = d.withColumn("bin", at.cast("long"))
    marked = [n for n in names if INTERACTION in n]
    d = confirmed_interaction(d, reference_lines(zones, extend, inner, tolerance), marked, keys, confirm_ms, most_deg)
    w = Window.partitionBy(*keys).orderBy("frame")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * m_per_px
    d = d.withColumns({"step": step, "place": F.row_number().over(w), "zone_before": F.lag("zone").over(w)})
    region = {z: r for r, zs in REGIONS.items() for z in zs}
    of = F.create_map(*(F.lit(v) for n in names for v in (n, region.get(n, n)))) if names else F.create_map(F.lit(""), F.lit(""))
    held = lambda z: F.try_element_at(of, z)
    d = d.withColumns({"body": F.when(F.col("zone").isNotNull(), held(F.col("zone"))), "before": F.when(F.col("zone_before").isNotNull(), held(F.col("zone_before")))})
    heads = F.array(
        F.when(F.col("head_zone").isNotNull() & ~F.col("head_zone").contains(INTERACTION), held(F.col("head_zone"))),
        *(F.when(F.col(f"confirmed_{i}"), F.lit(region.get(n, n))) for i, n in enumerate(marked)),
    )
    texts = [c for c in TEXTS[:5] if c in df.columns]
    flags = [f"{w}_{i}" for w in ("facing", "entered") for i in range(len(marked))]
    # read twice below
    d = written(d.select(*keys, *texts, "dt_us", "step", "place", "body", "before", heads.alias("heads"), *flags), "zone-table-frames")
    inside = F.concat(F.array(F.struct(F.lit("body").alias("kind"), F.col("body").alias("region"))), F.transform(F.array_distinct("heads"), lambda r: F.struct(F.lit("head").alias("kind"), r.alias("region"))))
    rows = d.select(*keys, "place", "dt_us", F.explode(inside).alias("r")).select(*keys, "place", "dt_us", "r.*").where("region IS NOT NULL")
    rows = rows.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*keys, "kind", "region").orderBy("place")))
    visits = rows.groupBy(*keys, "kind", "region", "run").agg(F.sum("dt_us").alias("us"), F.count("*").alias("n"))
    visits = visits.groupBy(*keys, "kind", "region").agg(F.sum("us").alias("us"), F.count_if((F.col("n") >= 2) & (F.col("us") >= least_dwell_us)).alias("entries"))
    regions = list(dict.fromkeys([*REGIONS, *(n for n in names if n not in region)]))
    pick = lambda r, k, c: F.coalesce(F.max(F.when((F.col("region") == r) & (F.col("kind") == k), F.col(c))), F.lit(0))
    cells = []
    for r in regions:
        for k in ("body", "head"):
            cells += [F.round(pick(r, k, "us") / 1e6, 3).alias(f"{r}_time_{k}"), pick(r, k, "entries").cast("long").alias(f"{r}_entries_{k}")]
    wide = visits.groupBy(*keys).agg(*cells)

    def angles(r: str) -> list[Column]:
        own = [i for i, n in enumerate(marked) if region.get(n, n) == r]
        time = sum((F.sum(F.when(F.col(f"facing_{i}"), F.col("dt_us")).otherwise(0.0)) for i in own), F.lit(0.0))
        count = sum((F.count_if(f"entered_{i}") for i in own), F.lit(0).cast("long"))
        names_ = {"Object1_IA": ("Object1_IA_time_angle", "Object1_IA-entries_angle")}.get(r, (f"{r}_time_angle", f"{r}_entries_angle") if r in REGIONS else (f"{r}_angle_time", f"{r}_angle_entries"))
        return [F.round(time / 1e6, 3).alias(names_[0]), count.cast("long").alias(names_[1])]

    path = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    within = lambda r: F.when((F.col("body") == r) & (F.col("before") == r), F.col("step"))
    texts = [F.coalesce(F.min(F.col(c).cast("string")), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in TEXTS[:5]]
    base = d.groupBy(*keys).agg(
        *texts,
        F.ceil(F.round(F.sum("dt_us") / 1e6, 9)).cast("long").alias("StateDur_s"),
        F.round(path(F.col("step")), 5).alias("Distance_m"),
        F.round(F.coalesce(F.max(F.when(F.col("dt_us") > 0, F.col("step") * 1e6 / F.col("dt_us"))), F.lit(0.0)), 4).alias("Max_speed"),
        *(F.round(path(within(r)), 5).alias(f"Distance_{r}_m") for r in ("Center", "NovelArm", "FamiliarArm")),
        *(c for r in regions if INTERACTION in r for c in angles(r)),
    )
    out = base.join(wide, [*keys], "left").withColumns({"State": F.col("state"), "Bin": bin_label(F.col("bin"), bin_s) if bin_s > 0 else F.lit("")})
    behind = [c for n in names if n not in region for c in (f"{n}_time_body", f"{n}_entries_body", f"{n}_time_head", f"{n}_entries_head", *((f"{n}_angle_time", f"{n}_angle_entries") if INTERACTION in n else ()))]
    return out.fillna(0, [c for c in out.columns if c not in TEXTS]).select("session", *(F.col(f"`{c}`") for c in (*COLUMNS, *behind)))
