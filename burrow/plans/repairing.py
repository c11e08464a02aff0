"""Queries of the repair across parts: an animal of seven parts moves as the vectors say, with swaps, thrown and missing parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import chain, repair
from burrow.plans.registry import query, table

#: Offsets of the parts from the animal's middle, in pixels.
BODY = ((30, 0), (18, 9), (18, -9), (0, 0), (-14, 8), (-14, -8), (-30, 0))
PARTS = ("nose", "left_ear", "right_ear", "middle", "left_hip", "right_hip", "tail")
PAIRS, AXIS = [(1, 2), (4, 5)], (0, 6)


def animals(spark, sf_dir, swapped: str = "frame % 9 = 4"):
    """Frames by label: turned by one number of the vector, placed by two, shaken by the others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame"), (F.col("vec_id") * 33_000).alias("t_us"), "embedding")
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    e = e.withColumns({"c": F.cos(9 * v(0)), "s": F.sin(9 * v(0)), "px": 400 + 200 * v(1), "py": 400 + 200 * v(2), "swap": F.expr(swapped)})
    cells = {"x": [], "y": []}
    for i, (bx, by) in enumerate(BODY):
        # the other part of a pair has the same offset on the other side
        across = F.when(F.col("swap"), -by).otherwise(by) if i in (1, 2) else F.lit(by)
        thrown = F.when((F.col("frame") + 5 * i) % 23 == 0, 45).otherwise(0)
        seen = (F.col("frame") * 7 + 3 * i) % 13 != 0
        cells["x"].append(F.when(seen, F.col("px") + F.col("c") * bx - F.col("s") * across + 3 * v(3 + i) + thrown))
        cells["y"].append(F.when(seen, F.col("py") + F.col("s") * bx + F.col("c") * across + 3 * v(13 + i)))
    return e.select("session", "frame", "t_us", *(F.array(*c).alias(k) for k, c in cells.items()), F.array(*(F.lit(0.9) for _ in BODY)).alias("conf"))


def _animals(swapped: str = "vec_id % 9 = 4") -> str:
    rows = ", ".join(f"({i}, {bx}, {by})" for i, (bx, by) in enumerate(BODY))
    return f"""b AS (SELECT * FROM (VALUES {rows}) t(i, ox, oy)), v AS (SELECT label::BIGINT AS session, vec_id AS frame, cos(9*embedding[1]::DOUBLE) AS c, sin(9*embedding[1]::DOUBLE) AS s, 400 + 200*embedding[2]::DOUBLE AS px, 400 + 200*embedding[3]::DOUBLE AS py, {swapped} AS swap, embedding FROM embeddings),
k AS MATERIALIZED (SELECT session, frame, i, CASE WHEN seen THEN px + c*ox - s*ac + 3*embedding[4 + i]::DOUBLE + thrown END AS x, CASE WHEN seen THEN py + s*ox + c*ac + 3*embedding[14 + i]::DOUBLE END AS y FROM
(SELECT *, CASE WHEN swap AND i IN (1, 2) THEN -oy ELSE oy END AS ac, CASE WHEN (frame + 5*i) % 23 = 0 THEN 45 ELSE 0 END AS thrown, (frame*7 + 3*i) % 13 <> 0 AS seen FROM v, b))"""


def _normal(rows: str) -> str:
    """Centred, and scaled to 1."""
    return f"""SELECT session, i, cx/max(sqrt(cx*cx + cy*cy)) OVER (PARTITION BY session) AS sx, cy/max(sqrt(cx*cx + cy*cy)) OVER (PARTITION BY session) AS sy
FROM (SELECT session, i, sx - avg(sx) OVER (PARTITION BY session) AS cx, sy - avg(sy) OVER (PARTITION BY session) AS cy FROM ({rows}))"""


def _fit(shape: str, points: str = "u", anchors: int = 3) -> str:
    """session, frame, ar, ai, br, bi."""
    return f"""SELECT session, frame, ar, ai, mx - ar*msx + ai*msy AS br, my - ar*msy - ai*msx AS bi FROM (SELECT *, (re - mx*msx - my*msy)/size AS ar, (im - my*msx + mx*msy)/size AS ai FROM
(SELECT session, frame, avg(x) AS mx, avg(y) AS my, avg(sx) AS msx, avg(sy) AS msy, avg(x*sx + y*sy) AS re, avg(y*sx - x*sy) AS im, avg(sx*sx + sy*sy) - pow(avg(sx), 2) - pow(avg(sy), 2) AS size FROM {points} JOIN {shape} USING (session, i) WHERE x IS NOT NULL GROUP BY session, frame HAVING count(sx) = count(*) AND count(*) >= {anchors}))"""


def shapes(rounds: int = 8, anchors: int = 3) -> str:
    """The rounds written out; a shape that has settled stays."""
    out = f"""u AS MATERIALIZED (SELECT session, frame, i, x, y FROM k QUALIFY count(x) OVER (PARTITION BY session, frame) >= {anchors}),
g AS (SELECT session, arg_max(frame, struct_pack(n := n, f := -frame)) AS frame FROM (SELECT session, frame, count(x) AS n FROM u GROUP BY ALL) GROUP BY session),
s0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS moved FROM ({_normal("SELECT session, i, x AS sx, y AS sy FROM u JOIN g USING (session, frame)")}))"""
    for r in range(1, rounds + 1):
        out += f""", f{r} AS MATERIALIZED ({_fit(f"s{r - 1}", anchors=anchors)}),
p{r} AS (SELECT session, i, avg(((x - br)*ar + (y - bi)*ai)/(ar*ar + ai*ai)) AS sx, avg(((y - bi)*ar - (x - br)*ai)/(ar*ar + ai*ai)) AS sy FROM u JOIN f{r} USING (session, frame) WHERE x IS NOT NULL GROUP BY session, i),
n{r} AS ({_normal(f"SELECT session, i, coalesce(p{r}.sx, s.sx) AS sx, coalesce(p{r}.sy, s.sy) AS sy FROM s{r - 1} s LEFT JOIN p{r} USING (session, i)")}),
s{r} AS MATERIALIZED (SELECT session, i, CASE WHEN was < 1e-6 THEN o.sx ELSE n.sx END AS sx, CASE WHEN was < 1e-6 THEN o.sy ELSE n.sy END AS sy, CASE WHEN was < 1e-6 THEN was ELSE max(sqrt(pow(n.sx - o.sx, 2) + pow(n.sy - o.sy, 2))) OVER (PARTITION BY n.session) END AS moved FROM n{r} n JOIN (SELECT *, moved AS was FROM s{r - 1}) o USING (session, i))"""
    return out


@query("learned_shapes", f"WITH {_animals()}, {shapes()} SELECT session, i::INT AS part, round(sx, 4) + 0.0 AS sx, round(sy, 4) + 0.0 AS sy FROM s8")
def learned_shapes(spark, sf_dir):
    d = repair.learned_shapes(animals(spark, sf_dir), len(PARTS))
    d = d.select("session", F.posexplode(F.arrays_zip("sx", "sy")).alias("part", "p"))
    return d.select("session", "part", *((F.round(f"p.{c}", 4) + 0.0).alias(c) for c in ("sx", "sy")))


@query("shape_unswapped", f"""WITH {_animals()}, {shapes()}, f AS MATERIALIZED ({_fit("s8")}),
w AS (SELECT session, frame, i, x, y, ar*sx - ai*sy + br AS fx, ar*sy + ai*sx + bi AS fy FROM u JOIN f USING (session, frame) JOIN s8 USING (session, i)),
q AS (SELECT a.session, a.frame, a.i AS pair, sqrt(pow(a.fx - a.x, 2) + pow(a.fy - a.y, 2)) + sqrt(pow(b.fx - b.x, 2) + pow(b.fy - b.y, 2)) AS keep, sqrt(pow(a.fx - b.x, 2) + pow(a.fy - b.y, 2)) + sqrt(pow(b.fx - a.x, 2) + pow(b.fy - a.y, 2)) AS turn FROM w a JOIN w b ON a.session = b.session AND a.frame = b.frame AND (a.i, b.i) IN ((1, 2), (4, 5)))
SELECT session, frame, pair::INT AS pair, turn < 0.6*keep AS exchanged FROM q WHERE keep IS NOT NULL AND turn IS NOT NULL""")
def shape_unswapped(spark, sf_dir):
    a = animals(spark, sf_dir)
    done = repair.shape_unswapped(a, repair.learned_shapes(a, len(PARTS)), PAIRS)
    both = [F.get("x", F.lit(i)).isNotNull() & F.get("x", F.lit(j)).isNotNull() for i, j in PAIRS]
    enough = F.size(F.array_compact("x")) >= 3
    rows = F.array(*(F.when(b & enough, F.struct(F.lit(i).alias("pair"), F.get("exchanged", F.lit(k)).alias("exchanged"))) for k, (b, (i, _)) in enumerate(zip(both, PAIRS))))
    return done.select("session", "frame", F.explode(F.array_compact(rows)).alias("r")).select("session", "frame", "r.*")


_EVIDENCE = """m AS (SELECT session, frame, max(x) FILTER (WHERE i = 0) AS hx, max(y) FILTER (WHERE i = 0) AS hy, max(x) FILTER (WHERE i = 6) AS tx, max(y) FILTER (WHERE i = 6) AS ty FROM k GROUP BY ALL),
l AS (SELECT *, sqrt(pow(hx - tx, 2) + pow(hy - ty, 2)) AS len FROM m), usual AS (SELECT session, quantile_cont(len, 0.5) AS med FROM l GROUP BY session),
e AS MATERIALIZED (SELECT l.session, l.frame, a.i AS pair, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, ((a.y - b.y)*(hx - tx) - (a.x - b.x)*(hy - ty))/nullif(len, 0) AS ac, len, med FROM l JOIN usual USING (session) JOIN k a USING (session, frame) JOIN k b ON a.session = b.session AND a.frame = b.frame AND (a.i, b.i) IN ((1, 2), (4, 5))),
ev AS MATERIALIZED (SELECT *, coalesce(CASE WHEN med > 0 AND len >= 0.25*med AND abs(ac) >= 0.04*med THEN (CASE WHEN ac > 0 THEN 1 ELSE -1 END)*least(abs(ac)/(0.5*med), 1) END, 0) AS side FROM e)"""


@query("swap_methods", f"""WITH {_animals("vec_id % 7 < 3")}, {_EVIDENCE}, j AS (SELECT session, pair, count(*) FILTER (WHERE side <> 0) AS judged, count(*) FILTER (WHERE side < 0) AS against FROM ev GROUP BY ALL)
SELECT session, CASE WHEN max(CASE WHEN judged >= 10 THEN against/judged END) >= 0.4 THEN 'anatomical' ELSE 'shape' END AS method FROM j GROUP BY session""")
def swap_methods(spark, sf_dir):
    return repair.swap_methods(animals(spark, sf_dir, "frame % 7 < 3"), AXIS, PAIRS)


@query("anatomy_unswapped", f"""WITH RECURSIVE {_animals("vec_id % 200 < 90")}, {_EVIDENCE}, md AS (SELECT session, i, quantile_cont(x, 0.5) AS ux, quantile_cont(y, 0.5) AS uy FROM k GROUP BY ALL),
o AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.session, pair ORDER BY frame) AS r, count(*) OVER (PARTITION BY ev.session, pair) AS top,
CASE WHEN side <> 0 THEN side ELSE 0.5*coalesce(greatest(least((sqrt(pow(x1 - c.ux, 2) + pow(y1 - c.uy, 2)) + sqrt(pow(x2 - a.ux, 2) + pow(y2 - a.uy, 2)) - sqrt(pow(x1 - a.ux, 2) + pow(y1 - a.uy, 2)) - sqrt(pow(x2 - c.ux, 2) + pow(y2 - c.uy, 2)))/(2*CASE WHEN sqrt(pow(a.ux - c.ux, 2) + pow(a.uy - c.uy, 2)) > 0 THEN sqrt(pow(a.ux - c.ux, 2) + pow(a.uy - c.uy, 2)) ELSE 1 END), 1), -1), 0) END AS told
FROM ev JOIN md a ON a.session = ev.session AND a.i = pair JOIN md c ON c.session = ev.session AND c.i = pair + 1),
n AS (SELECT session, pair, r, 0 + greatest(0, -told) AS b0, 0 + greatest(0, told) AS b1, 0 AS k0, 1 AS k1 FROM o WHERE r = 1 UNION ALL
SELECT o.session, o.pair, o.r, least(n.b0, n.b1 + 0.15) + greatest(0, -told), least(n.b1, n.b0 + 0.15) + greatest(0, told), CASE WHEN n.b1 + 0.15 < n.b0 THEN 1 ELSE 0 END, CASE WHEN n.b0 + 0.15 < n.b1 THEN 0 ELSE 1 END FROM n JOIN o ON o.session = n.session AND o.pair = n.pair AND o.r = n.r + 1),
z AS (SELECT n.session, n.pair, n.r, CASE WHEN b1 < b0 THEN 1 ELSE 0 END AS s FROM n JOIN o USING (session, pair, r) WHERE n.r = o.top UNION ALL
SELECT n.session, n.pair, n.r - 1, CASE WHEN z.s = 0 THEN n.k0 ELSE n.k1 END FROM z JOIN n ON n.session = z.session AND n.pair = z.pair AND n.r = z.r WHERE n.r > 1)
SELECT session, frame, pair::INT AS pair, z.s = 1 AND x1 IS NOT NULL AND x2 IS NOT NULL AS exchanged FROM z JOIN o USING (session, pair, r)""")
def anatomy_unswapped(spark, sf_dir):
    d = repair.anatomy_unswapped(animals(spark, sf_dir, "frame % 200 < 90"), AXIS, PAIRS)
    rows = F.array(*(F.struct(F.lit(i).alias("pair"), F.get("exchanged", F.lit(k)).alias("exchanged")) for k, (i, _) in enumerate(PAIRS)))
    return d.select("session", "frame", F.explode(rows).alias("r")).select("session", "frame", "r.*")


@query("steady_poses", """WITH v AS (SELECT label::BIGINT AS session, vec_id AS frame, CASE WHEN vec_id % 10 <> 3 THEN 20.0 + embedding[1] END AS ar, CASE WHEN vec_id % 10 <> 3 THEN 3*embedding[2]::DOUBLE END AS ai, CASE WHEN vec_id % 10 <> 3 THEN vec_id + 30*embedding[3]::DOUBLE END AS br, CASE WHEN vec_id % 10 <> 3 THEN 10*embedding[4]::DOUBLE END AS bi FROM embeddings),
m AS (SELECT *, ar IS NOT NULL AS ok, quantile_cont(ar, 0.5) OVER w AS mar, quantile_cont(ai, 0.5) OVER w AS mai, quantile_cont(br, 0.5) OVER w AS mbr, quantile_cont(bi, 0.5) OVER w AS mbi FROM v WINDOW w AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
n AS (SELECT *, ok AND sqrt(pow(br - mbr, 2) + pow(bi - mbi, 2)) <= 0.25*sqrt(mar*mar + mai*mai) AND sqrt(pow(ar - mar, 2) + pow(ai - mai, 2)) <= 0.25*sqrt(mar*mar + mai*mai) AS near FROM m),
c AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY session) AS poses, count(*) FILTER (WHERE near) OVER (PARTITION BY session) AS kept FROM n)
SELECT session, frame, CASE WHEN poses >= 3 AND kept >= greatest(2, floor(0.2*poses)) THEN coalesce(near, false) ELSE ok END AS steady FROM c""")
def steady_poses(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    there = lambda c: F.when(F.col("vec_id") % 10 != 3, c)
    p = e.select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame"), there(20 + v(0)).alias("ar"), there(3 * v(1)).alias("ai"), there(F.col("vec_id") + 30 * v(2)).alias("br"), there(10 * v(3)).alias("bi"))
    return repair.steady(p).select("session", "frame", "steady")


_CHAIN = chain.Chain(PARTS, tuple((PARTS[i], PARTS[j]) for i, j in PAIRS), (PARTS[AXIS[0]], PARTS[AXIS[1]]), ("nose", "middle"), body_part="middle")


@query("built_track")
def built_track(spark, sf_dir):
    d = chain.built_track(repair.pointed(animals(spark, sf_dir), list(PARTS)), _CHAIN)
    return d.select("session", "frame", *(F.round(c, 4).alias(c) for c in ("x", "y", "step", "speed")))


@query("corrected_points")
def corrected_points(spark, sf_dir):
    d = chain.corrected_points(repair.pointed(animals(spark, sf_dir), list(PARTS)), _CHAIN)
    return d.select("session", "frame", "part", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "filled")
