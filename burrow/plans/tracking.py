"""Queries of the live filters and of what runs tell, in batch; the streams' tests hold them against these. The twins are recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import events, live, tracking
from burrow.plans.registry import FRAMES, frames, query

#: Frames of a session on a clock a million times as fast; two of five events are frames without a position.
_SEEN = f"""{FRAMES}, m AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame) AS i, t_us // 1000000 AS t, CASE WHEN zone NOT IN ('signup', 'error') THEN speed END AS x, k::DOUBLE AS y, (k % 10)/10.0 AS conf FROM d)"""


def positions(spark, sf_dir):
    f = frames(spark, sf_dir)
    x = F.when(~F.col("zone").isin("signup", "error"), F.col("speed"))
    return f.select("session", "frame", F.expr("t_us div 1000000").alias("t_us"), x.alias("x"), F.col("k").cast("double").alias("y"), (F.col("k") % 10 / 10.0).alias("conf"))


@query("live_points", f"""WITH RECURSIVE {_SEEN}, n AS (SELECT *, coalesce(x IS NOT NULL AND conf >= 0.1, false) AS seen FROM m), fs AS (SELECT session, min(i) AS i FROM n WHERE seen GROUP BY session),
r AS (SELECT session, i, t, x AS px, y AS py, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 1.0::DOUBLE AS p, 0.0::DOUBLE AS r, 1.0::DOUBLE AS s, 0 AS misses, conf::DOUBLE AS c FROM n JOIN fs USING (session, i) UNION ALL
SELECT session, i, t, qx + g*(x0 - qx), qy + g*(y0 - qy), u + e*(x0 - qx), v + e*(y0 - qy), pp - g*pp, rr - g*rr, ss - e*rr, CASE WHEN seen THEN 0 ELSE misses + 1 END, CASE WHEN seen THEN conf ELSE c END FROM
(SELECT *, CASE WHEN seen THEN pp/(pp + 4*least(10, 1/greatest(conf, 0.1))) ELSE 0 END AS g, CASE WHEN seen THEN rr/(pp + 4*least(10, 1/greatest(conf, 0.1))) ELSE 0 END AS e, CASE WHEN seen THEN x ELSE qx END AS x0, CASE WHEN seen THEN y ELSE qy END AS y0 FROM
(SELECT session, i, t, seen, x, y, conf, misses, c, u, v, px + h*u AS qx, py + h*v AS qy, p + 2*h*r + h*h*s + 90000*h*h*h/3 AS pp, r + h*s + 90000*h*h/2 AS rr, s + 90000*h AS ss FROM
(SELECT n.session, n.i, n.t, n.seen, n.x, n.y, n.conf::DOUBLE AS conf, r.px, r.py, r.u, r.v, r.p, r.r, r.s, r.misses, r.c, least(greatest((n.t - r.t)/1e6, 0.001), 1.0) AS h FROM r JOIN n ON n.session = r.session AND n.i = r.i + 1))))
SELECT m.session, m.frame, CASE WHEN misses <= 5 THEN round(px, 4) END AS x, CASE WHEN misses <= 5 THEN round(py, 4) END AS y, CASE WHEN misses <= 5 THEN round(c*(1 - misses/6.0), 4) END AS conf, coalesce(misses BETWEEN 1 AND 5, false) AS filled FROM m LEFT JOIN r ON r.session = m.session AND r.i = m.i""")
def live_points(spark, sf_dir):
    d = tracking.kept_points(positions(spark, sf_dir), keys=("session",))
    return d.select("session", "frame", F.round("kx", 4).alias("x"), F.round("ky", 4).alias("y"), F.round("kconf", 4).alias("conf"), "filled")


def _axis(place: str, speed: str, push: str, seen: str) -> str:
    return f"{place} + g*({seen} - {place}), {speed} + e*({seen} - {place}), {push} + f*({seen} - {place})"


@query("live_centres", f"""WITH RECURSIVE {_SEEN}, n AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS seen FROM m), fs AS (SELECT session, min(i) AS i FROM n WHERE seen GROUP BY session),
r AS (SELECT session, i, t, x AS px, 0.0::DOUBLE AS u, 0.0::DOUBLE AS a, y AS py, 0.0::DOUBLE AS v, 0.0::DOUBLE AS b, 10.0::DOUBLE AS xx, 0.0::DOUBLE AS xu, 0.0::DOUBLE AS xa, 50.0::DOUBLE AS uu, 0.0::DOUBLE AS ua, 100.0::DOUBLE AS aa, 0 AS misses, x AS tx, y AS ty FROM n JOIN fs USING (session, i) UNION ALL
SELECT session, i, t, {_axis('qx', 'u', 'a', 'x0')}, {_axis('qy', 'v', 'b', 'y0')}, xx - g*xx, xu - g*xu, xa - g*xa, uu - e*xu, ua - e*xa, aa - f*xa, CASE WHEN seen THEN 0 ELSE misses + 1 END, CASE WHEN NOT seen AND misses >= 3 THEN tx ELSE qx + g*(x0 - qx) END, CASE WHEN NOT seen AND misses >= 3 THEN ty ELSE qy + g*(y0 - qy) END FROM
(SELECT *, CASE WHEN seen THEN xx/(xx + w) ELSE 0 END AS g, CASE WHEN seen THEN xu/(xx + w) ELSE 0 END AS e, CASE WHEN seen THEN xa/(xx + w) ELSE 0 END AS f, CASE WHEN seen THEN x ELSE qx END AS x0, CASE WHEN seen THEN y ELSE qy END AS y0 FROM
(SELECT session, i, t, seen, x, y, misses, tx, ty, 4*least(10, 1/greatest(conf, 0.1)) AS w, px + h*u + k*a AS qx, u + h*a AS u, a, py + h*v + k*b AS qy, v + h*b AS v, b,
xx + 2*h*xu + 2*k*xa + h*h*uu + 2*h*k*ua + k*k*aa + 0.5*h AS xx, xu + h*xa + h*uu + h*h*ua + k*ua + h*k*aa AS xu, xa + h*ua + k*aa AS xa, uu + 2*h*ua + h*h*aa + 2*h AS uu, ua + h*aa AS ua, aa + 5*h AS aa FROM
(SELECT *, h*h/2 AS k FROM (SELECT n.session, n.i, n.t, n.seen, n.x, n.y, n.conf::DOUBLE AS conf, r.* EXCLUDE (session, i, t), CASE WHEN n.t > r.t THEN least(greatest((n.t - r.t)/1e6, 0.001), 1.0) ELSE 1/30.0 END AS h FROM r JOIN n ON n.session = r.session AND n.i = r.i + 1)))))
SELECT m.session, m.frame, round(tx, 3) AS x, round(ty, 3) AS y, CASE WHEN misses > 3 THEN 0 ELSE round(u, 2) + 0.0 END AS vx, round(CASE WHEN misses > 3 THEN tx ELSE px + u*0.05 + a*0.00125 END, 3) AS ahead, coalesce(misses > 3, false) AS lost FROM m LEFT JOIN r ON r.session = m.session AND r.i = m.i""")
def live_centres(spark, sf_dir):
    d = tracking.centres(positions(spark, sf_dir), tracking.CentreFilter(most_misses=3))
    return d.select("session", "frame", F.round("cx", 3).alias("x"), F.round("cy", 3).alias("y"), (F.round("vx", 2) + 0.0).alias("vx"), F.round(tracking.forecast("x", F.lit(50)), 3).alias("ahead"), "lost")


@query("live_parts", """WITH RECURSIVE n AS (SELECT label::BIGINT AS session, vec_id AS frame, 'p' || j AS part, row_number() OVER (PARTITION BY label, j ORDER BY vec_id) AS i, vec_id * 33000 AS t, CASE WHEN (vec_id // 60 + j) % 4 <> 0 THEN 100*embedding[2*j+1]::DOUBLE END AS x, 100*embedding[2*j+2]::DOUBLE AS y FROM embeddings, range(0, 8) q(j)),
f AS (SELECT session, part, min(i) AS i FROM n WHERE x IS NOT NULL GROUP BY ALL),
r AS (SELECT session, part, i, t, x AS px, y AS py, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 1.0::DOUBLE AS p, 0.0::DOUBLE AS r, 1.0::DOUBLE AS s, 0 AS misses FROM n JOIN f USING (session, part, i) UNION ALL
SELECT session, part, i, t, qx + g*(x0 - qx), qy + g*(y0 - qy), u + e*(x0 - qx), v + e*(y0 - qy), pp - g*pp, rr - g*rr, ss - e*rr, CASE WHEN x IS NOT NULL THEN 0 ELSE misses + 1 END FROM
(SELECT *, CASE WHEN x IS NOT NULL THEN pp/(pp + 5) ELSE 0 END AS g, CASE WHEN x IS NOT NULL THEN rr/(pp + 5) ELSE 0 END AS e, coalesce(x, qx) AS x0, CASE WHEN x IS NOT NULL THEN y ELSE qy END AS y0 FROM
(SELECT session, part, i, t, x, y, misses, u, v, px + h*u AS qx, py + h*v AS qy, p + 2*h*r + h*h*s + 90000*h*h*h/3 AS pp, r + h*s + 90000*h*h/2 AS rr, s + 90000*h AS ss FROM
(SELECT n.session, n.part, n.i, n.t, n.x, n.y, r.* EXCLUDE (session, part, i, t), least(greatest((n.t - r.t)/1e6, 0.001), 1.0) AS h FROM r JOIN n ON n.session = r.session AND n.part = r.part AND n.i = r.i + 1))))
SELECT n.session, n.part, count(*) FILTER (WHERE misses = 0) AS seen, count(*) FILTER (WHERE misses BETWEEN 1 AND 5) AS filled, count(*) FILTER (WHERE coalesce(misses, 9) > 5) AS gone, round(sum(CASE WHEN misses <= 5 THEN px END), 3) AS sum_x, round(sum(CASE WHEN misses <= 5 THEN py END), 3) AS sum_y FROM n LEFT JOIN r ON r.session = n.session AND r.part = n.part AND r.i = n.i GROUP BY ALL""")
def live_parts(spark, sf_dir):
    """Eight parts of each frame, each missing for stretches of 60 vectors."""
    from burrow.plans.registry import table

    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"), "embedding")
    at = lambda k: 100 * F.get("embedding", 2 * F.col("j") + k).cast("double")
    x = F.when((F.expr("frame div 60") + F.col("j")) % 4 != 0, at(0))
    p = e.select("session", "frame", F.concat(F.lit("p"), F.col("j").cast("string")).alias("part"), (F.col("frame") * 33_000).alias("t_us"), x.alias("x"), at(1).alias("y"), F.lit(0.8).alias("conf"))
    told = F.col("kx").isNotNull()
    return tracking.kept_points(p).groupBy("session", "part").agg(F.count_if(told & ~F.col("filled")).alias("seen"), F.count_if("filled").alias("filled"), F.count_if(~told).alias("gone"), F.round(F.sum("kx"), 3).alias("sum_x"), F.round(F.sum("ky"), 3).alias("sum_y"))


_DAY = 86_400_000_000


@query("stall_events", f"""WITH {FRAMES}, g AS (SELECT session, t_us, lag(t_us) OVER w AS b, coalesce(lead(t_us) OVER w, (SELECT max(t_us) FROM d)) AS a FROM d WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, t_us + {2 * _DAY} AS t_us, 'stalled' AS event FROM g WHERE a - t_us > {2 * _DAY} UNION ALL SELECT session, t_us, 'recovered' FROM g WHERE t_us - b > {2 * _DAY}""")
def stall_events(spark, sf_dir):
    f = frames(spark, sf_dir)
    return live.stall_edges(f, 2 * _DAY, f.agg(F.max("t_us")).first()[0])


@query("run_ticks", f"""WITH {FRAMES}, r AS (SELECT *, sum((zone = 'signup')::INT) OVER (PARTITION BY session ORDER BY frame) AS run, max(t_us) OVER (PARTITION BY session) AS fin FROM d),
s AS (SELECT *, sum((zone = 'error')::INT) OVER (PARTITION BY session, run ORDER BY frame) AS stops FROM r WHERE run > 0),
p AS (SELECT session, run, fin, min(t_us) FILTER (WHERE zone = 'signup') AS since, min(t_us) FILTER (WHERE zone = 'error') AS stopped FROM s GROUP BY ALL),
u AS (SELECT *, coalesce(stopped, lead(since) OVER (PARTITION BY session ORDER BY run), fin) AS until FROM p),
t AS (SELECT session, run, since + i*{_DAY} AS t_us FROM u, unnest(range(1, (until - since)//{_DAY} + 1)) q(i)),
c AS (SELECT t.session, t.t_us, count(*) FILTER (WHERE zone = 'click') AS clicks, count(*) FILTER (WHERE zone = 'purchase') AS purchases FROM t LEFT JOIN s ON s.session = t.session AND s.run = t.run AND s.zone <> 'signup' AND s.stops = 0 AND s.t_us < t.t_us GROUP BY ALL)
SELECT *, round(CASE WHEN clicks <> 0 THEN 100.0*purchases/clicks ELSE 0 END, 6) AS share FROM c""")
def run_ticks(spark, sf_dir):
    t = live.ticks(frames(spark, sf_dir), {"clicks": "click", "purchases": "purchase"}, F.col("zone") == "signup", F.col("zone") == "error", _DAY, name="zone")
    return events.calculated(t, {"share": "round(100 * purchases / clicks, 6)"})


@query("run_resets", f"""WITH {FRAMES}, r AS (SELECT *, sum((zone = 'signup')::INT) OVER (PARTITION BY session ORDER BY frame)::BIGINT AS run FROM d),
m AS (SELECT *, lag(zone) OVER (PARTITION BY session, run ORDER BY frame) AS bz, lag(t_us) OVER (PARTITION BY session, run ORDER BY frame) AS bt FROM r WHERE zone IN ('view', 'purchase'))
SELECT session, frame, run, 'count' AS kind, zone || 's' AS label, count(*) OVER (PARTITION BY session, run, zone ORDER BY frame) AS value FROM r WHERE zone IN ('click', 'view')
UNION ALL SELECT session, frame, run, 'latency', 'bought', t_us - bt FROM m WHERE zone = 'purchase' AND bz = 'view'
UNION ALL SELECT session, frame, run, 'token', upper(zone[1]), row_number() OVER (PARTITION BY session, run ORDER BY frame) FROM r WHERE zone IN ('click', 'purchase')""")
def run_resets(spark, sf_dir):
    return live.run_messages(frames(spark, sf_dir), F.col("zone") == "signup", {"clicks": "click", "views": "view"}, {"bought": ("view", "purchase")}, {"C": "click", "P": "purchase"}, name="zone")


@query("queue_policies", f"""WITH {FRAMES}, q AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame DESC) AS z, row_number() OVER (PARTITION BY session ORDER BY frame) AS a FROM d)
SELECT policy, session, count(*) FILTER (WHERE CASE policy WHEN 'drop_oldest' THEN z <= 10 WHEN 'drop_newest' THEN a <= 10 ELSE true END) AS kept, min(frame) FILTER (WHERE CASE policy WHEN 'drop_oldest' THEN z <= 10 WHEN 'drop_newest' THEN a <= 10 ELSE true END) AS first FROM q, (VALUES ('lossless'), ('drop_oldest'), ('drop_newest')) p(policy) GROUP BY ALL""")
def queue_policies(spark, sf_dir):
    """What a queue of ten rows a session delivers of one batch, under each policy."""
    from burrow.streaming import rules

    f, out = frames(spark, sf_dir).select("session", "frame"), None
    for p in rules.POLICIES:
        q = rules.queued(f, "session", "frame", 10, p).where("kept").groupBy(F.lit(p).alias("policy"), "session").agg(F.count("*").alias("kept"), F.min("frame").alias("first"))
        out = q if out is None else out.unionByName(q)
    return out
