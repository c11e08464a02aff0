"""Queries of rasters, legacy edges and targets, confirmed interaction and the wide zone table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from burrow.functions import geometry
from burrow.operators import raster, zone_table, zones
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.plans.space import _inside

#: A layout over x 0 to 500 and y 0 to 100; no border runs through a point of the frames.
LAYOUT = {
    "Social_IA": [(0.255, 0.25), (120.255, 0.25), (120.255, 40.25), (0.255, 45.31)],
    "Social": [(20.255, 5.25), (60.255, 5.25), (60.255, 20.25), (20.255, 20.25)],
    "Object1_IA": [(380.255, 60.25), (500.255, 55.31), (500.255, 110.25), (380.255, 110.25)],
    "CenterZone": [(120.255, 20.25), (380.255, 20.25), (380.255, 80.25), (120.255, 80.25)],
    "OpenArm": [(0.255, 45.25), (110.255, 45.25), (110.255, 110.25), (0.255, 110.25)],
    "NovelArm": [(390.255, 0.25), (500.255, 0.25), (500.255, 50.31)],
    "Extra_IA": [(150.255, 80.25), (350.255, 80.25), (350.255, 110.25), (150.255, 110.25)],
}


def layout(spark):
    rows = [(n, i, [(float(x), float(y)) for x, y in p]) for i, (n, p) in enumerate(LAYOUT.items())]
    return spark.createDataFrame(rows, "name string, ord int, points array<struct<x:double,y:double>>")


#: Concave and convex zones for pixels.
PIXELS = {"arrow": [(10.4, 10.6), (90.2, 50.3), (10.4, 90.1), (35.0, 50.5)], "box": [(200.0, 20.0), (300.0, 20.0), (300.0, 80.0), (200.0, 80.0)], "thin": [(250.0, 0.0), (450.0, 99.0), (452.0, 99.0)], "wide": [(-40.0, 5.0), (480.0, 5.0), (480.0, 95.0), (-40.0, 95.0)]}


def _pixel_in(points) -> str:
    """Whether the pixel (px, py) is in: its middle by the even-odd rule, or on a border line's pixel."""
    corners = [(round(x), round(y)) for x, y in points]
    terms, lines = [], []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay != by:
            terms.append(f"CASE WHEN (({ay} > py) <> ({by} > py)) AND px < {ax} + (py - ({ay})) * ({bx - ax}) / ({by - ay})::DOUBLE THEN 1 ELSE 0 END")
        if abs(bx - ax) >= abs(by - ay):
            lines.append(f"(px BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND py = floor({ay} + abs(px - ({ax})) * ({by - ay}) / {max(abs(bx - ax), 1)}::DOUBLE + 0.5))")
        else:
            lines.append(f"(py BETWEEN {min(ay, by)} AND {max(ay, by)} AND px = floor({ax} + abs(py - ({ay})) * ({bx - ax}) / {abs(by - ay)}::DOUBLE + 0.5))")
    return f"((({' + '.join(terms)}) % 2 = 1) OR {' OR '.join(lines)})"


_SMALLEST = sorted(PIXELS, key=lambda n: (abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(PIXELS[n], PIXELS[n][1:] + PIXELS[n][:1]))) / 2, list(PIXELS).index(n)))


@query("raster_zones", f"""WITH {FRAMES}, p AS (SELECT session, frame, round_even(speed - 5, 0) AS px, round_even(k + 0.5, 0) AS py, speed - 5 BETWEEN -0.5 AND 479.5 AND k + 0.5 BETWEEN -0.5 AND 99.5 AS ins FROM d),
q AS (SELECT session, frame, least(greatest(px, 0), 479) AS px, least(greatest(py, 0), 99) AS py, ins FROM p)
SELECT session, frame, CASE WHEN NOT ins THEN '' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN {_pixel_in(PIXELS[n])} THEN '{n}' END" for n in _SMALLEST)}], lambda n: n IS NOT NULL), '|') END AS held FROM q""")
def raster_zones(spark, sf_dir):
    z = spark.createDataFrame([(n, i, [(float(x), float(y)) for x, y in p]) for i, (n, p) in enumerate(PIXELS.items())], "name string, ord int, points array<struct<x:double,y:double>>")
    f = frames(spark, sf_dir).select("session", "frame", (F.col("speed") - 5).alias("x"), (F.col("k") + 0.5).alias("y"))
    return raster.looked_up(f, z, 480, 100).select("session", "frame", F.array_join("held", "|").alias("held"))


@query("border_zones", f"""WITH {FRAMES}, p AS (SELECT session, frame, floor(speed / 10) * 10 AS x, (k // 10 * 10)::DOUBLE AS y FROM d)
SELECT session, frame, CASE WHEN x BETWEEN 20 AND 60 AND y BETWEEN 20 AND 60 THEN 'box' WHEN x >= 0 AND y >= 0 AND x + y <= 100 THEN 'tri' END AS zone FROM p""")
def border_zones(spark, sf_dir):
    """Points and corners on whole tens, so that many points lie on a border, which belongs to its zone."""
    z = spark.createDataFrame([("box", 0, [(20.0, 20.0), (60.0, 20.0), (60.0, 60.0), (20.0, 60.0)]), ("tri", 1, [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0)])], "name string, ord int, points array<struct<x:double,y:double>>")
    f = frames(spark, sf_dir).select("session", "frame", (F.floor(F.col("speed") / 10) * 10).cast("double").alias("x"), F.expr("cast(k div 10 * 10 AS double)").alias("y"))
    return zones.located(f, z, "first", border=True).select("session", "frame", "zone")


@query("outermost_edges", """WITH b AS (SELECT s_suppkey AS id, radians(s_suppkey * 7 % 180) AS t, (s_suppkey % 9 * 40 - 150)::DOUBLE AS mx, (s_suppkey % 7 * 30 - 80)::DOUBLE AS my FROM supplier),
e AS (SELECT id, i, mx + cos(t)*ux - sin(t)*uy AS px, my + sin(t)*ux + cos(t)*uy AS py, long FROM b, (VALUES (0, 0.0, -4.0, 20.0), (1, 10.0, 0.0, 8.0), (2, 0.0, 4.0, 20.0), (3, -10.0, 0.0, 8.0)) q(i, ux, uy, long)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY px*px + py*py DESC, i) AS k FROM e WHERE long = 20)
SELECT id, round(px, 4) + 0.0 AS mx, round(py, 4) + 0.0 AS my FROM r WHERE k = 1""")
def outermost_edges(spark, sf_dir):
    """Boxes of 20 by 8, turned and set about the origin: of the two long sides, which run alike, the farther one's middle."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.radians((F.col("s_suppkey") * 7 % 180).cast("double")).alias("t"), (F.col("s_suppkey") % 9 * 40 - 150).cast("double").alias("mx"), (F.col("s_suppkey") % 7 * 30 - 80).cast("double").alias("my"))
    corner = lambda ux, uy: F.struct((F.col("mx") + F.cos("t") * ux - F.sin("t") * uy).alias("x"), (F.col("my") + F.sin("t") * ux + F.cos("t") * uy).alias("y"))
    s = s.select("id", F.array(corner(-10, -4), corner(10, -4), corner(10, 4), corner(-10, 4)).alias("points"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    middle = lambda c: (F.round((F.col("edge.a")[c] + F.col("edge.b")[c]) / 2, 4) + 0.0).alias(f"m{c}")
    return zone_table.outermost_edges(s).select("id", middle("x"), middle("y"))


@query("interaction_targets", """WITH z AS (SELECT n_regionkey AS layout, n_nationkey AS ord, replace(n_name, ' ', '_') || CASE WHEN n_nationkey % 3 = 0 THEN '_IA' ELSE '' END AS name, (n_nationkey * 37 % 100)::DOUBLE AS x, (n_nationkey * 53 % 90)::DOUBLE AS y FROM nation
UNION ALL SELECT n_regionkey, n_nationkey + 100, CASE WHEN n_nationkey % 2 = 0 THEN replace(n_name, ' ', '_') ELSE 'near_' || lower(replace(n_name, ' ', '-')) END, (n_nationkey * 11 % 100)::DOUBLE, (n_nationkey * 17 % 90)::DOUBLE FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 4 <> 1),
w AS (SELECT *, list_filter(string_split(lower(replace(name, '-', '_')), '_'), lambda t: t <> '' AND t <> 'ia') AS words FROM z),
j AS (SELECT a.layout, a.name, b.name AS target, b.x, b.y, b.ord, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS far, CASE WHEN b.name = replace(a.name, '_IA', '') THEN 0 WHEN b.name = a.name THEN 3 WHEN contains(b.name, '_IA') THEN NULL WHEN list_has_all(b.words, a.words) THEN 1 ELSE 2 END AS rank FROM w a JOIN w b USING (layout) WHERE contains(a.name, '_IA'))
SELECT layout, name, target, x AS tx, y AS ty FROM j WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY layout, name ORDER BY rank, CASE WHEN rank = 0 THEN 0 ELSE far END, ord) = 1""")
def interaction_targets(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k, plain = F.col("n_nationkey").cast("int"), F.replace("n_name", F.lit(" "), F.lit("_"))
    at = lambda x, y: F.array(*(F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((-3, -1), (3, -1), (0, 2))))
    one = n.select(F.col("n_regionkey").alias("layout"), k.alias("ord"), F.concat(plain, F.when(k % 3 == 0, "_IA").otherwise("")).alias("name"), at(k * 37 % 100, k * 53 % 90).alias("points"))
    two = n.where((k % 3 == 0) & (k % 4 != 1)).select(F.col("n_regionkey").alias("layout"), (k + 100).alias("ord"), F.when(k % 2 == 0, plain).otherwise(F.concat(F.lit("near_"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))))).alias("name"), at(k * 11 % 100, k * 17 % 90).alias("points"))
    return zone_table.targets(one.unionByName(two), ("layout",))


def _lines() -> dict[str, tuple]:
    """Outer line, a point of the inner line and the normal of each interaction zone, by plain arithmetic."""
    mean = lambda p: (sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p))
    cx, cy = mean([mean(p) for p in LAYOUT.values()])
    out = {}
    for name, p in LAYOUT.items():
        if "_IA" not in name:
            continue
        groups: list[tuple[float, list]] = []
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
            angle = (math.degrees(math.atan2(by - ay, bx - ax)) + 180) % 180
            edge = (math.hypot(bx - ax, by - ay), ((ax + bx) / 2 - cx) ** 2 + ((ay + by) / 2 - cy) ** 2, ax, ay, bx, by)
            own = next((g for g in groups if abs(g[0] - angle) <= 15), None)
            own[1].append(edge) if own else groups.append((angle, [edge]))
        _, _, ax, ay, bx, by = max(max(groups, key=lambda g: max(e[0] for e in g[1]))[1], key=lambda e: e[1])
        ux, uy = (bx - ax) / math.hypot(bx - ax, by - ay), (by - ay) / math.hypot(bx - ax, by - ay)
        ax, ay, bx, by = ax - 15 * ux, ay - 15 * uy, bx + 15 * ux, by + 15 * uy
        nx, ny = -uy, ux
        if nx * (cx - (ax + bx) / 2) + ny * (cy - (ay + by) / 2) < 0:
            nx, ny = -nx, -ny
        out[name] = (ax, ay, bx, by, ax + 20 * nx, ay + 20 * ny, nx, ny)
    return out


def _first(x: str, y: str) -> str:
    return "CASE " + " ".join(f"WHEN {_inside(p)} THEN '{n}'" for n, p in LAYOUT.items()).replace("> y)", f"> {y})").replace("(y - ", f"({y} - ").replace("x < ", f"{x} < ") + " END"


_MARKED = list(_lines())
_GROUP = "PARTITION BY session, st, bin"


def _confirmed() -> str:
    """The confirmations of each interaction zone, one expression after the other."""
    out, last = [], "g0"
    for i, (n, (ax, ay, bx, by, ox, oy, nx, ny)) in enumerate(_lines().items()):
        long = (bx - ax) ** 2 + (by - ay) ** 2
        out.append(f"""a{i} AS (SELECT *, coalesce(hz = '{n}' AND (hx - {ox})*{nx} + (hy - {oy})*{ny} <= 0, false) AS near, least(greatest(((hx - {ax})*{bx - ax} + (hy - {ay})*{by - ay})/{long}, 0), 1) AS u FROM {last}),
b{i} AS (SELECT *, sum(turn) OVER ({_GROUP} ORDER BY frame) AS run FROM (SELECT *, CASE WHEN near = lag(near) OVER ({_GROUP} ORDER BY frame) THEN 0 ELSE 1 END AS turn, {ax} + u*{bx - ax} AS px, {ay} + u*{by - ay} AS py FROM a{i})),
c{i} AS (SELECT *, near AND sum(dt) OVER ({_GROUP}, run ORDER BY frame) >= 400000 AS ok, sqrt(pow(hx - x, 2) + pow(hy - y, 2))*sqrt(pow(px - hx, 2) + pow(py - hy, 2)) AS sz, (hx - x)*(px - hx) + (hy - y)*(py - hy) AS dot FROM b{i}),
e{i} AS (SELECT *, coalesce(ok AND sz > 0 AND degrees(acos(least(greatest(dot/CASE WHEN sz > 0 THEN sz END, -1), 1))) <= 45, false) AS face FROM c{i}),
h{i} AS (SELECT *, sum(t2) OVER ({_GROUP} ORDER BY frame) AS r2 FROM (SELECT *, CASE WHEN face = lag(face) OVER ({_GROUP} ORDER BY frame) THEN 0 ELSE 1 END AS t2 FROM e{i})),
k{i} AS (SELECT *, face AND row_number() OVER ({_GROUP}, r2 ORDER BY frame) > 1 AND ms - first_value(ms) OVER ({_GROUP}, r2 ORDER BY frame) >= 400 AS told FROM h{i}),
g{i + 1} AS (SELECT * EXCLUDE (near, u, turn, px, py, run, ok, sz, dot, face, t2, r2, told), ok AS ok{i}, face AS face{i}, told AND NOT coalesce(lag(told) OVER ({_GROUP} ORDER BY frame), false) AS ent{i} FROM k{i})""")
        last = f"g{i + 1}"
    return ",\n".join(out)


_REGION = {z: r for r, zs in zone_table.REGIONS.items() for z in zs}
_OF = lambda c: "CASE " + " ".join(f"WHEN {c} = '{n}' THEN '{_REGION.get(n, n)}'" for n in LAYOUT) + " END"
_EXTRA = [c for n in LAYOUT if n not in _REGION for c in (f"{n}_time_body", f"{n}_entries_body", f"{n}_time_head", f"{n}_entries_head", *((f"{n}_angle_time", f"{n}_angle_entries") if "_IA" in n else ()))]


def _cell(column: str) -> str:
    """One column of the wide table from the groups' sums."""
    for i, n in enumerate(_MARKED):
        r = _REGION.get(n, n)
        if column in (f"{r}_time_angle", f"{r}_angle_time"):
            return f"any_value(fa{i})"
        if column in (f"{r}_entries_angle", f"{r}-entries_angle", f"{r}_angle_entries"):
            return f"any_value(en{i})::BIGINT"
    for kind in ("body", "head"):
        for what, pick in (("time", "us"), ("entries", "n")):
            if column.endswith(f"_{what}_{kind}"):
                v = f"coalesce(max(v.{pick}) FILTER (WHERE v.region = '{column.removesuffix(f'_{what}_{kind}')}' AND v.kind = '{kind}'), 0)"
                return f"round({v}/1e6, 3)" if what == "time" else f"{v}::BIGINT"
    known = {"StateDur_s": "any_value(dur)", "Distance_m": "any_value(dist)", "Max_speed": "any_value(top)", "State": "st", "Bin": "bin * 10 || '-' || (bin + 1) * 10 || 's'"} | {f"Distance_{r}_m": f"any_value(d_{r})" for r in ("Center", "NovelArm", "FamiliarArm")}
    if column in known:
        return known[column]
    return "''" if column in zone_table.TEXTS else "0::BIGINT" if "entries" in column else "0.0::DOUBLE"


@query("interaction_table", f"""WITH {FRAMES}, f1 AS (SELECT session, frame, t_us/97000000.0 AS ms, speed AS x, k::DOUBLE AS y, speed + (k % 7 - 3)*2 AS hx, k + (k % 5 - 2)*3.0 AS hy, CASE WHEN k < 50 THEN 'low' ELSE 'high' END AS st FROM d),
f2 AS (SELECT *, {_first("x", "y")} AS zone, {_first("hx", "hy")} AS hz, coalesce((ms - lag(ms) OVER (PARTITION BY session ORDER BY frame))*1000, 0) AS dt FROM f1),
g0 AS (SELECT *, floor((ms - min(ms) OVER (PARTITION BY session, st))/10000)::BIGINT AS bin FROM f2),
{_confirmed()},
s AS (SELECT *, {_OF("zone")} AS body, {_OF("lag(zone) OVER (" + _GROUP + " ORDER BY frame)")} AS was, 0.001*sqrt(pow(x - lag(x) OVER ({_GROUP} ORDER BY frame), 2) + pow(y - lag(y) OVER ({_GROUP} ORDER BY frame), 2)) AS step, row_number() OVER ({_GROUP} ORDER BY frame) AS place FROM g{len(_MARKED)}),
m AS (SELECT session, st, bin, place, dt, 'body' AS kind, body AS region FROM s UNION ALL SELECT session, st, bin, place, dt, 'head', unnest(list_distinct([CASE WHEN NOT contains(hz, '_IA') THEN {_OF("hz")} END, {', '.join(f"CASE WHEN ok{i} THEN '{_REGION.get(n, n)}' END" for i, n in enumerate(_MARKED))}])) FROM s),
r AS (SELECT *, place - row_number() OVER (PARTITION BY session, st, bin, kind, region ORDER BY place) AS run FROM m WHERE region IS NOT NULL),
w AS (SELECT session, st, bin, kind, region, run, sum(dt) AS us, count(*) AS n FROM r GROUP BY ALL),
v AS (SELECT session, st, bin, kind, region, sum(us) AS us, count(*) FILTER (WHERE n >= 2 AND us >= 200000) AS n FROM w GROUP BY ALL),
base AS (SELECT session, st, bin, ceil(round(sum(dt)/1e6, 9))::BIGINT AS dur, round(coalesce(sum(step), 0), 5) AS dist, round(coalesce(max(CASE WHEN dt > 0 THEN step*1e6/dt END), 0), 4) AS top,
{', '.join(f"round(coalesce(sum(step) FILTER (WHERE body = '{r}' AND was = '{r}'), 0), 5) AS d_{r}" for r in ("Center", "NovelArm", "FamiliarArm"))},
{', '.join(f"round(coalesce(sum(dt) FILTER (WHERE face{i}), 0)/1e6, 3) AS fa{i}, count(*) FILTER (WHERE ent{i}) AS en{i}" for i in range(len(_MARKED)))} FROM s GROUP BY ALL)
SELECT session, {', '.join(f'{_cell(c)} AS "{c}"' for c in (*zone_table.COLUMNS, *_EXTRA))} FROM base LEFT JOIN v USING (session, st, bin) GROUP BY session, st, bin""")
def interaction_table(spark, sf_dir):
    """The whole wide table in bins of ten seconds; time runs 97,000 times as fast."""
    z = layout(spark)
    f = frames(spark, sf_dir)
    k = F.col("k")
    f = f.select("session", "frame", (F.col("t_us") / 97_000_000.0).alias("t_ms"), F.col("speed").alias("x"), k.cast("double").alias("y"), (F.col("speed") + (k % 7 - 3) * 2).alias("hx"), (k + (k % 5 - 2) * 3.0).alias("hy"), F.when(k < 50, "low").otherwise("high").alias("state"))
    f = zones.located(f, z, "first", border=True)
    return zone_table.zone_table(f, z, list(LAYOUT), 0.001, bin_s=10.0, confirm_ms=400.0, inner=20.0)


@query("zone_areas", """WITH z AS (SELECT c_nationkey AS nation, min(c_custkey) AS lo, max(c_custkey) AS hi, round(max(c_acctbal) - min(c_acctbal), 2) AS high FROM customer GROUP BY c_nationkey)
SELECT nation, round((hi - lo)*high/2 + (hi - lo)*10, 4) AS area, round((lo + hi + hi + lo)/4.0, 4) AS cx, round((0 + 0 + high + 20)/4.0, 4) AS cy FROM z""")
def zone_areas(spark, sf_dir):
    """Area and centre of a zone for each nation: as wide as its customers' keys, as high as their balances spread on one side and 20 on the other."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").cast("double").alias("lo"), F.max("c_custkey").cast("double").alias("hi"), F.round(F.max("c_acctbal") - F.min("c_acctbal"), 2).alias("high"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), y.alias("y"))
    p = F.array(at("lo", F.lit(0.0)), at("hi", F.lit(0.0)), at("hi", F.col("high")), at("lo", F.lit(20.0)))
    m = geometry.centroid(p)
    return c.select("nation", F.round(geometry.area(p), 4).alias("area"), F.round(m["x"], 4).alias("cx"), F.round(m["y"], 4).alias("cy"))
