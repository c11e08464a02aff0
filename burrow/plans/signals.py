"""Queries of cleaned and filtered signals. The twins of recursive filters are recursive, too."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import clean, series
from burrow.plans.registry import FRAMES, frames, query

_C = f"{FRAMES}, p AS (SELECT session, frame, t_us, dt_us, speed AS x, k::DOUBLE AS y, (k % 10)/10.0 AS conf FROM d)"


#: Frames in order, for recursive filters: each step joins a session's next frame.
_N = f"RECURSIVE {_C}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY frame) AS i FROM p)"


def points(spark, sf_dir):
    return series.intervals(frames(spark, sf_dir)).withColumn("conf", (F.col("k") % 10) / 10.0)


def _xy(df):
    return df.select("session", "frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("gate_conf", f"WITH {_C} SELECT session, frame, CASE WHEN conf >= 0.55 THEN round(x, 4) END AS x, CASE WHEN conf >= 0.55 THEN round(y, 4) END AS y FROM p")
def gate_conf(spark, sf_dir):
    return _xy(clean.gate(points(spark, sf_dir), 0.55))


@query("part_gate", f"""WITH {_C}, l AS (SELECT session, least(greatest(quantile_cont(conf, 0.05), 0.1), 0.6) AS lim FROM p GROUP BY session)
SELECT session, frame, CASE WHEN conf IS NULL OR conf >= lim THEN round(x, 4) END AS x, CASE WHEN conf IS NULL OR conf >= lim THEN round(y, 4) END AS y FROM p JOIN l USING (session)""")
def part_gate(spark, sf_dir):
    return _xy(clean.part_gate(points(spark, sf_dir)))


_JUMP = """j AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS jump FROM p WINDOW w AS (PARTITION BY session ORDER BY frame)),
q AS (SELECT session, quantile_cont(jump, 0.25) AS q1, quantile_cont(jump, 0.5) AS q2, quantile_cont(jump, 0.75) AS q3, count(jump) AS n FROM j GROUP BY session),
m AS (SELECT j.session, quantile_cont(abs(jump - q2), 0.5) AS mad FROM j JOIN q USING (session) GROUP BY j.session),
l AS (SELECT session, n, q2 + %s * CASE WHEN q3 - q1 > 0 THEN q3 - q1 WHEN mad > 0 THEN 1.4826*mad ELSE greatest(0.25*q2, 1) END AS lim FROM q JOIN m USING (session))"""


@query("jump_limit", f"WITH {_C}, {_JUMP % '0.9'} SELECT session, frame, CASE WHEN coalesce(n >= 8 AND jump > lim, false) THEN NULL ELSE round(x, 4) END AS x, CASE WHEN coalesce(n >= 8 AND jump > lim, false) THEN NULL ELSE round(y, 4) END AS y FROM j JOIN l USING (session)")
def jump_limit(spark, sf_dir):
    return _xy(clean.jump_gate(points(spark, sf_dir), spreads=0.9))


@query("teleport_clamp", f"""WITH {_C}, j AS (SELECT *, coalesce(dt_us > 0 AND sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))*1e6/dt_us > 0.001, false) AS bad FROM p WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, frame, CASE WHEN NOT bad THEN round(x, 4) END AS x, CASE WHEN NOT bad THEN round(y, 4) END AS y FROM j""")
def teleport_clamp(spark, sf_dir):
    return _xy(clean.teleport_gate(points(spark, sf_dir), 0.001))


@query("gap_fill", f"""WITH {_C}, g AS (SELECT session, frame, t_us, CASE WHEN conf >= 0.4 THEN x END AS x FROM p),
b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t_us END IGNORE NULLS) OVER a AS ta, last_value(x IGNORE NULLS) OVER a AS xa, first_value(CASE WHEN x IS NOT NULL THEN t_us END IGNORE NULLS) OVER z AS tb, first_value(x IGNORE NULLS) OVER z AS xb FROM g
WINDOW a AS (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT session, frame, round(coalesce(x, CASE WHEN tb - ta <= 36000000000 THEN xa + (xb - xa)*(t_us - ta)/(tb - ta) END), 4) AS x FROM b""")
def gap_fill(spark, sf_dir):
    p = clean.gate(points(spark, sf_dir), 0.4)
    return clean.fill_gaps(p, 36_000_000_000, "t_us", "x").select("session", "frame", F.round("x", 4).alias("x"))


@query("rolling_median", f"WITH {_C} SELECT session, frame, round(quantile_cont(CASE WHEN conf >= 0.4 THEN x END, 0.5) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS med FROM p")
def rolling_median(spark, sf_dir):
    return clean.rolling_median(clean.gate(points(spark, sf_dir), 0.4), "x", "med").select("session", "frame", F.round("med", 4).alias("med"))


@query("savgol_interior", f"""WITH {_C}, i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session) AS n, (-2*lag(x,3) OVER w + 3*lag(x,2) OVER w + 6*lag(x,1) OVER w + 7*x + 6*lead(x,1) OVER w + 3*lead(x,2) OVER w - 2*lead(x,3) OVER w)/21.0 AS s FROM p WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, frame, round(s, 4) AS smooth FROM i WHERE i > 3 AND i <= n - 3""")
def savgol_interior(spark, sf_dir):
    from pyspark.sql import Window

    s = clean.savgol(points(spark, sf_dir), "x", "smooth").withColumns({"i": F.row_number().over(series.along()), "n": F.count("*").over(Window.partitionBy("session"))})
    return s.where("i > 3 AND i <= n - 3").select("session", "frame", F.round("smooth", 4).alias("smooth"))


def _mirrored(k: int) -> str:
    """Place i + k, folded back at both ends."""
    j = f"(i + {k})"
    return f"xs[CASE WHEN {j} < 1 THEN 2 - {j} WHEN {j} > n THEN 2*n - {j} ELSE {j} END]"


_SMOOTH = " + ".join(f"{c}*{_mirrored(k)}" for k, c in zip(range(-3, 4), (-2, 3, 6, 7, 6, 3, -2)))


@query("savgol_smooth", f"WITH {_C}, l AS (SELECT session, list(x ORDER BY frame) AS xs, list(frame ORDER BY frame) AS fs, count(*) AS n FROM p GROUP BY session) SELECT session, fs[i] AS frame, round(CASE WHEN n >= 7 THEN ({_SMOOTH})/21.0 ELSE xs[i] END, 4) AS smooth FROM l, unnest(range(1, n + 1)) u(i)")
def savgol_smooth(spark, sf_dir):
    """All frames, the first and last three too."""
    return clean.savgol(points(spark, sf_dir), "x", "smooth").select("session", "frame", F.round("smooth", 4).alias("smooth"))


def _share(cutoff: str) -> str:
    return f"(2*pi()*({cutoff})*gap/(2*pi()*({cutoff})*gap + 1))"


@query("one_euro", f"""WITH {_N}, r AS (SELECT session, frame, i, x AS level, 0.0::DOUBLE AS slope, t_us AS since FROM n WHERE i = 1 UNION ALL
SELECT session, frame, i, CASE WHEN gap > 0 THEN level + {_share('1 + 0.007*abs(s2)')}*(x - level) ELSE level END, CASE WHEN gap > 0 THEN s2 ELSE slope END, CASE WHEN gap > 0 THEN t_us ELSE since END FROM
(SELECT *, slope + {_share('1')}*((x - level)/gap - slope) AS s2 FROM (SELECT n.session, n.frame, n.i, n.x, n.t_us, r.level, r.slope, r.since, (n.t_us - r.since)/1e6 AS gap FROM r JOIN n ON n.session = r.session AND n.i = r.i + 1)))
SELECT session, frame, round(level, 4) AS smooth FROM r""")
def one_euro(spark, sf_dir):
    return clean.one_euro(points(spark, sf_dir), "x", "smooth").select("session", "frame", F.round("smooth", 4).alias("smooth"))


@query("rts_smoother", f"""WITH {_N}, d2 AS (SELECT *, x - 2*lag(x) OVER w + lag(x, 2) OVER w AS sx, y - 2*lag(y) OVER w + lag(y, 2) OVER w AS sy FROM n WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY frame)),
m2 AS (SELECT *, quantile_cont(sx, 0.5) OVER (PARTITION BY session) AS mx, quantile_cont(sy, 0.5) OVER (PARTITION BY session) AS my FROM d2),
g AS (SELECT session, count(*) AS c, quantile_cont(abs(sx - mx), 0.5) AS dx, quantile_cont(abs(sy - my), 0.5) AS dy, quantile_cont(CASE WHEN dt_us > 0 THEN dt_us/1e6 END, 0.5) AS st FROM m2 GROUP BY session),
q AS (SELECT session, CASE WHEN c >= 8 AND st > 0 THEN greatest((greatest(pow(1.4826*dx, 2) - 24, 0)/pow(st, 4) + greatest(pow(1.4826*dy, 2) - 24, 0)/pow(st, 4))/2, 4/pow(st, 4)*0.01) ELSE 1000 END AS q, coalesce(st, 1/30.0) AS med FROM g),
v AS (SELECT n.session, frame, i, x AS v, 4/least(greatest(conf, 0.05), 1) AS noise, q, CASE WHEN dt_us > 0 THEN dt_us/1e6 ELSE med END AS h FROM n JOIN q USING (session)),
fw AS (SELECT session, i, q, h, v AS x, 0.0::DOUBLE AS u, noise::DOUBLE AS a, 0.0::DOUBLE AS b, q*h*h AS d FROM v WHERE i = 1 UNION ALL
SELECT session, i, q, h, px + pa/(pa + noise)*(v - px), u + pb/(pa + noise)*(v - px), pa - pa/(pa + noise)*pa, pb - pa/(pa + noise)*pb, pd - pb/(pa + noise)*pb FROM
(SELECT v.session, v.i, v.q, v.h, v.v, v.noise, fw.x + v.h*fw.u AS px, fw.u, fw.a + v.h*(2*fw.b + v.h*fw.d) + v.q*v.h*v.h*v.h/3 AS pa, fw.b + v.h*fw.d + v.q*v.h*v.h/2 AS pb, fw.d + v.q*v.h AS pd FROM fw JOIN v ON v.session = fw.session AND v.i = fw.i + 1)),
sm AS (SELECT fw.session, fw.i, x, u, fw.h FROM fw JOIN (SELECT session, max(i) AS i FROM v GROUP BY session) top USING (session, i) UNION ALL
SELECT session, i, CASE WHEN det > 0 THEN x + (a + h1*b)*ex/det + b*eu/det ELSE x END, CASE WHEN det > 0 THEN u + (b + h1*d)*ex/det + d*eu/det ELSE u END, h FROM
(SELECT *, pa*pd - pb*pb AS det, pd*(x1 - x - h1*u) - pb*(u1 - u) AS ex, pa*(u1 - u) - pb*(x1 - x - h1*u) AS eu FROM
(SELECT fw.*, sm.x AS x1, sm.u AS u1, sm.h AS h1, fw.a + sm.h*(2*fw.b + sm.h*fw.d) + fw.q*sm.h*sm.h*sm.h/3 AS pa, fw.b + sm.h*fw.d + fw.q*sm.h*sm.h/2 AS pb, fw.d + fw.q*sm.h AS pd FROM sm JOIN fw ON fw.session = sm.session AND fw.i = sm.i - 1)))
SELECT v.session, v.frame, round(sm.x, 4) AS smooth FROM sm JOIN v USING (session, i)""")
def rts_smoother(spark, sf_dir):
    p = clean.process_variance(points(spark, sf_dir), "x", "y", 2.0)
    return clean.rts(p, "x", "smooth", conf="conf").select("session", "frame", F.round("smooth", 4).alias("smooth"))


@query("held_clamp", f"""WITH {_N}, r AS (SELECT session, frame, i, x AS cx, y AS cy FROM n WHERE i = 1 UNION ALL
SELECT session, frame, i, CASE WHEN far THEN cx ELSE x END, CASE WHEN far THEN cy ELSE y END FROM (SELECT n.session, n.frame, n.i, n.x, n.y, r.cx, r.cy, n.dt_us <> 0 AND sqrt(pow(n.x - r.cx, 2) + pow(n.y - r.cy, 2))*1e6/n.dt_us > 0.001 AS far FROM r JOIN n ON n.session = r.session AND n.i = r.i + 1))
SELECT session, frame, cx AS clamped_x, cy AS clamped_y FROM r""")
def held_clamp(spark, sf_dir):
    return clean.held_clamp(points(spark, sf_dir), 0.001).select("session", "frame", "clamped_x", "clamped_y")


@query("forward_clock", f"""WITH {_N}, m AS (SELECT session, frame, i, t_us/1000.0 - CASE WHEN y % 11 = 0 THEN 100.0 ELSE 0.0 END AS ms FROM n),
r AS (SELECT session, frame, i, ms AS last FROM m WHERE i = 1 UNION ALL SELECT m.session, m.frame, m.i, CASE WHEN r.last - m.ms > 0 AND r.last - m.ms <= 250 THEN r.last ELSE m.ms END FROM r JOIN m ON m.session = r.session AND m.i = r.i + 1)
SELECT session, frame, last AS monotone FROM r""")
def forward_clock(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("ms", F.col("t_us") / 1000.0 - F.when(F.col("k") % 11 == 0, 100.0).otherwise(0.0))
    return clean.forward_clock(p, "ms", "monotone").select("session", "frame", "monotone")


@query("two_state_path", f"""WITH {_N}, e AS (SELECT session, frame, i, greatest(0, -(y - 50)/100.0) AS h0, greatest(0, (y - 50)/100.0) AS h1, max(i) OVER (PARTITION BY session) AS top FROM n),
a AS (SELECT session, i, h0 AS b0, h1 AS b1, 0 AS k0, 1 AS k1 FROM e WHERE i = 1 UNION ALL
SELECT e.session, e.i, least(a.b0, a.b1 + 0.15) + e.h0, least(a.b1, a.b0 + 0.15) + e.h1, CASE WHEN a.b1 + 0.15 < a.b0 THEN 1 ELSE 0 END, CASE WHEN a.b0 + 0.15 < a.b1 THEN 0 ELSE 1 END FROM a JOIN e ON e.session = a.session AND e.i = a.i + 1),
z AS (SELECT a.session, a.i, CASE WHEN b1 < b0 THEN 1 ELSE 0 END AS s FROM a JOIN e ON e.session = a.session AND e.i = a.i WHERE a.i = e.top UNION ALL
SELECT a.session, a.i - 1, CASE WHEN z.s = 0 THEN a.k0 ELSE a.k1 END FROM z JOIN a ON a.session = z.session AND a.i = z.i WHERE a.i > 1)
SELECT e.session, e.frame, z.s = 1 AS swap FROM z JOIN e ON e.session = z.session AND e.i = z.i""")
def two_state_path(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("evidence", (F.col("k") - 50) / 100.0)
    return clean.two_state_path(p, "evidence", "swap").select("session", "frame", "swap")


@query("crossed_pairs", f"""WITH {_N}, b AS (SELECT session, frame, i, CASE WHEN y % 9 = 0 THEN x + 40 ELSE x END AS ax, CASE WHEN y % 9 = 0 THEN x ELSE x + 40 END AS bx, y FROM n),
r AS (SELECT session, frame, i, false AS crossed, ax AS px, bx AS qx, y AS py FROM b WHERE i = 1 UNION ALL
SELECT session, frame, i, crossed <> flips, CASE WHEN flips THEN two ELSE one END, CASE WHEN flips THEN one ELSE two END, y FROM (SELECT *, stay > 0 AND (stay - turn)/stay > 0.3 AS flips FROM
(SELECT *, sqrt(pow(one - px, 2) + pow(y - py, 2)) + sqrt(pow(two - qx, 2) + pow(y - py, 2)) AS stay, sqrt(pow(two - px, 2) + pow(y - py, 2)) + sqrt(pow(one - qx, 2) + pow(y - py, 2)) AS turn FROM
(SELECT b.session, b.frame, b.i, b.y, r.crossed, r.px, r.qx, r.py, CASE WHEN r.crossed THEN b.bx ELSE b.ax END AS one, CASE WHEN r.crossed THEN b.ax ELSE b.bx END AS two FROM r JOIN b ON b.session = r.session AND b.i = r.i + 1))))
SELECT session, frame, crossed FROM r""")
def crossed_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    flip = F.col("k") % 9 == 0
    a, b = F.struct("x", "y"), F.struct((F.col("x") + 40).alias("x"), F.col("y").alias("y"))
    p = p.withColumns({"pa": F.when(flip, b).otherwise(a), "pb": F.when(flip, a).otherwise(b)})
    p = p.withColumns({"ax": F.col("pa.x"), "ay": F.col("pa.y"), "bx": F.col("pb.x"), "by": F.col("pb.y")}).drop("pa", "pb")
    return clean.crossed_pairs(p).select("session", "frame", "crossed")
