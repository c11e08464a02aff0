"""Queries of rules, interaction, shapes and the wide zone table."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import pose, rules, series
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.plans.repairing import shapes


@query("rule_states", f"""WITH {FRAMES}, a AS (SELECT session, frame, t_us, coalesce(zone IN ('click', 'view'), false) AS raw FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR raw = lag(raw) OVER w THEN 0 ELSE 1 END AS ch FROM a WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
h AS (SELECT *, raw AND t_us - min(t_us) OVER (PARTITION BY session, run) >= 600000000 AS active FROM r)
SELECT session, frame, 'long' AS rule, active, active AND NOT coalesce(lag(active) OVER (PARTITION BY session ORDER BY frame), false) AS fired FROM h
UNION ALL SELECT session, frame, 'out', NOT raw, NOT raw AND lag(raw) OVER (PARTITION BY session ORDER BY frame) IS NOT NULL AND coalesce(lag(raw) OVER (PARTITION BY session ORDER BY frame), true) FROM h""")
def rule_states(spark, sf_dir):
    z = ("click", "view")
    return rules.states(frames(spark, sf_dir), [rules.Rule("long", "in_zone", zones=z, duration_us=600_000_000), rules.Rule("out", "exit_edge", zones=z)])


@query("interaction_score", f"""WITH {FRAMES}, a AS (SELECT session, frame, dt_us, k, coalesce(zone = 'view', false) AS inz, coalesce(zone = 'view' AND speed > 5, false) AS near FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR near = lag(near) OVER w THEN 0 ELSE 1 END AS ch FROM a WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
h AS (SELECT *, near AND sum(dt_us) OVER (PARTITION BY session, run ORDER BY frame ROWS UNBOUNDED PRECEDING) >= 60000000 AS conf FROM r),
e AS (SELECT *, conf AND NOT coalesce(lag(conf) OVER (PARTITION BY session, run ORDER BY frame), false) AS ent FROM h)
SELECT session, coalesce(sum(dt_us) FILTER (WHERE inz), 0)::BIGINT AS zone_us, coalesce(sum(dt_us) FILTER (WHERE near), 0)::BIGINT AS near_us, coalesce(sum(dt_us) FILTER (WHERE conf AND k <= 45), 0)::BIGINT AS investigating_us, count(*) FILTER (WHERE ent) AS entries FROM e GROUP BY session""")
def interaction_score(spark, sf_dir):
    d = series.intervals(frames(spark, sf_dir))
    return rules.interaction(d, F.col("zone") == "view", F.col("speed") > 5, F.col("k"), confirm_us=60_000_000)


@query("zone_stats_table", f"""WITH {FRAMES}, g AS (SELECT *, CASE WHEN k < 50 THEN 'low' ELSE 'high' END AS st FROM d WHERE k IS NOT NULL), b AS (SELECT *, floor((t_us - min(t_us) OVER (PARTITION BY session, st))/86400000000)::BIGINT AS bin FROM g),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (st = lag(st) OVER w AND bin = lag(bin) OVER w AND zone IS NOT DISTINCT FROM lag(zone) OVER w) THEN 0 ELSE 1 END AS ch FROM b WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
v AS (SELECT session, st, bin, run, zone, sum(dt_us) AS us, count(*) AS n, sum(step) AS path, max(speed) AS top FROM r GROUP BY ALL)
SELECT session, st AS state, bin, round(sum(path), 3) AS path, max(top) AS top_speed, coalesce(sum(us) FILTER (WHERE zone = 'click'), 0)::BIGINT AS click_us, count(*) FILTER (WHERE zone = 'click' AND us >= 60000000 AND n >= 2) AS click_entries,
coalesce(sum(us) FILTER (WHERE zone = 'view'), 0)::BIGINT AS view_us, count(*) FILTER (WHERE zone = 'view' AND us >= 60000000 AND n >= 2) AS view_entries FROM v GROUP BY ALL""")
def zone_stats_table(spark, sf_dir):
    d = series.steps(series.intervals(frames(spark, sf_dir)).withColumn("given", F.col("speed"))).withColumn("state", F.when(F.col("k") < 50, "low").when(F.col("k") >= 50, "high"))
    out = rules.zone_stats(d, "state", "zone", ["click", "view"], 86_400_000_000, 60_000_000, speed="given")
    return out.withColumn("path", F.round("path", 3))


def keypoints(spark, sf_dir):
    """embeddings as keypoints: the first 16 numbers of a vector are 8 parts' x and y; every 11th part is missing."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), "embedding")
    missing = (F.col("frame") + F.col("i")) % 11 == 0
    at = lambda k: F.when(~missing, F.get("embedding", 2 * F.col("i") + k).cast("double"))
    return p.select("session", "frame", F.concat(F.lit("p"), F.col("i").cast("string")).alias("part"), at(0).alias("x"), at(1).alias("y"))


_KEYPOINTS = """k AS (SELECT label::BIGINT AS session, vec_id AS frame, 'p' || i AS part, CASE WHEN (vec_id + i) % 11 <> 0 THEN embedding[2*i+1]::DOUBLE END AS x, CASE WHEN (vec_id + i) % 11 <> 0 THEN embedding[2*i+2]::DOUBLE END AS y FROM embeddings, range(0, 8) t(i))"""


@query("detection_rate", f"WITH {_KEYPOINTS}, f AS (SELECT session, frame, count(x) AS seen FROM k GROUP BY ALL) SELECT session, count(*) AS frames, round(avg(CASE WHEN seen > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(seen), 6) AS parts FROM f GROUP BY session")
def detection_rate(spark, sf_dir):
    f = keypoints(spark, sf_dir).groupBy("session", "frame").agg(F.count("x").alias("seen"))
    return f.groupBy("session").agg(F.count("*").alias("frames"), F.round(F.avg((F.col("seen") > 0).cast("double")), 6).alias("rate"), F.round(F.avg("seen"), 6).alias("parts"))


@query("side_evidence", f"""WITH {_KEYPOINTS}, w AS (SELECT session, frame, {', '.join(f"max({c}) FILTER (WHERE part = '{p}') AS {p}_{c}" for p in ('p0', 'p1', 'p2', 'p3') for c in 'xy')} FROM k GROUP BY session, frame),
a AS (SELECT *, sqrt(pow(p0_x - p1_x, 2) + pow(p0_y - p1_y, 2)) AS axis FROM w), m AS (SELECT session, quantile_cont(axis, 0.5) AS med FROM a GROUP BY session),
e AS (SELECT a.*, med, ((p2_y - p3_y)*(p0_x - p1_x) - (p2_x - p3_x)*(p0_y - p1_y))/nullif(axis, 0) AS ac FROM a JOIN m USING (session))
SELECT session, frame, round(coalesce(CASE WHEN axis >= 0.25*med AND abs(ac) >= 0.04*med AND med > 0 THEN sign(ac)*least(abs(ac)/(0.5*med), 1) END, 0), 4) AS evidence FROM e""")
def side_evidence(spark, sf_dir):
    w = pose.wide(keypoints(spark, sf_dir), ["p0", "p1", "p2", "p3"])
    return pose.side_evidence(w, "p0", "p1", "p2", "p3").select("session", "frame", F.round("evidence", 4).alias("evidence"))


def _placed(points: str, n: int) -> str:
    """e<n>: points (session, frame, i, part, x, y) with the places where the shape that has settled puts them, px and py, and how many are seen."""
    return f"""t{n} AS (SELECT session, frame, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(sx) AS msx, avg(sy) AS msy, avg(sx*sx + sy*sy) AS ss, avg(x*sx + y*sy) AS re, avg(y*sx - x*sy) AS im FROM {points} JOIN s8 USING (session, i) WHERE x IS NOT NULL GROUP BY ALL),
h{n} AS (SELECT session, frame, n, mx - ar*msx + ai*msy AS br, my - ar*msy - ai*msx AS bi, ar, ai FROM (SELECT *, (re - mx*msx - my*msy)/(ss - msx*msx - msy*msy) AS ar, (im - my*msx + mx*msy)/(ss - msx*msx - msy*msy) AS ai FROM t{n} WHERE n >= 2 AND ss - msx*msx - msy*msy > 1e-12)),
e{n} AS MATERIALIZED (SELECT session, frame, i, part, x, y, n, ar*sx - ai*sy + br AS px, ar*sy + ai*sx + bi AS py, sqrt(pow(x - (ar*sx - ai*sy + br), 2) + pow(y - (ar*sy + ai*sx + bi), 2)) AS res FROM {points} LEFT JOIN s8 USING (session, i) LEFT JOIN h{n} USING (session, frame))"""


def _dropped(n: int) -> str:
    """m<n>: e<n>'s points without the one of each frame that is farthest off, where it is too far."""
    return f"""w{n} AS (SELECT session, frame, arg_max(i, struct_pack(res := res, part := part)) AS worst FROM e{n} WHERE res IS NOT NULL GROUP BY ALL),
o{n} AS (SELECT session, frame, worst, quantile_cont(res, 0.5) FILTER (WHERE i <> worst) AS others FROM e{n} JOIN w{n} USING (session, frame) GROUP BY ALL),
m{n} AS MATERIALIZED (SELECT session, frame, i, part, CASE WHEN bad THEN NULL ELSE x END AS x, CASE WHEN bad THEN NULL ELSE y END AS y FROM (SELECT *, coalesce(i = worst AND res > 0.35*body AND res > 2*coalesce(others, 0) AND n >= 3, false) AS bad FROM e{n} LEFT JOIN o{n} USING (session, frame) LEFT JOIN body USING (session)))"""


_FITTED = f"{_KEYPOINTS.replace('k AS (SELECT', 'k AS MATERIALIZED (SELECT i,')}, {shapes(anchors=2)}, {_placed('k', 0)}"
_BODY = "pd AS (SELECT a.session, a.frame, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS far FROM k a JOIN k b ON a.session = b.session AND a.frame = b.frame WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL), body AS (SELECT session, quantile_cont(far, 0.5) AS body FROM pd WHERE far > 0 GROUP BY session)"


@query("shape_residuals", f"WITH {_FITTED} SELECT session, frame, part, round(res, 6) AS residual FROM e0")
def shape_residuals(spark, sf_dir):
    k = keypoints(spark, sf_dir)
    return pose.residuals(k, pose.canonical_shape(k)).select("session", "frame", "part", F.round("residual", 6).alias("residual"))


@query("placed_parts", f"""WITH {_FITTED}, {_BODY}, {_dropped(0)}, {_placed("m0", 1)}, {_dropped(1)}, {_placed("m1", 2)}, {_dropped(2)}, {_placed("m2", 3)}
SELECT session, frame, part, round(px, 6) + 0.0 AS x, round(py, 6) + 0.0 AS y FROM e3 WHERE x IS NULL AND px IS NOT NULL AND n >= 3""")
def placed_parts(spark, sf_dir):
    k = keypoints(spark, sf_dir)
    shape = pose.canonical_shape(k)
    return pose.place_missing(pose.drop_mistracks(k, shape), shape).where("placed").select("session", "frame", "part", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))
