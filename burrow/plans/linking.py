"""Queries of joins between series, logs and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import joins, series
from burrow.plans.registry import FRAMES, frames, query, table

_LOG = "lg AS (SELECT session, frame, t_us, zone AS state FROM f WHERE k >= 80)"


def _state_log(f):
    return f.where("k >= 80").select("session", "frame", "t_us", F.col("zone").alias("state"))


@query("asof_state", f"""WITH {FRAMES}, {_LOG}, p AS (SELECT session, frame, t_us FROM f WHERE k < 40) SELECT p.session, p.frame, lg.state FROM p ASOF LEFT JOIN lg ON p.session = lg.session AND p.t_us >= lg.t_us""")
def asof_state(spark, sf_dir):
    f = frames(spark, sf_dir)
    return joins.as_of(f.where("k < 40").select("session", "frame", "t_us"), _state_log(f), "session", "t_us", "state", "state", "frame").select("session", "frame", "state")


@query("clock_mapping", f"""WITH {FRAMES}, an AS (SELECT session, t_us, t_us * 2 + 5 AS other FROM f WHERE k >= 90), p AS (SELECT session, frame, t_us FROM f WHERE k < 40)
SELECT p.session, p.frame, an.other + (p.t_us - an.t_us) AS mapped FROM p ASOF LEFT JOIN an ON p.session = an.session AND p.t_us >= an.t_us""")
def clock_mapping(spark, sf_dir):
    f = frames(spark, sf_dir)
    anchors = f.where("k >= 90").select("session", "frame", "t_us", (F.col("t_us") * 2 + 5).alias("other"))
    return joins.mapped_clock(f.where("k < 40").select("session", "frame", "t_us"), anchors, "session", "t_us", "other", "mapped", "frame").select("session", "frame", "mapped")


@query("locf_state", f"""WITH {FRAMES} SELECT session, frame, last_value(CASE WHEN k >= 80 THEN zone END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS held FROM f""")
def locf_state(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("mark", F.when(F.col("k") >= 80, F.col("zone")))
    return series.carried(f, "mark", "held").select("session", "frame", "held")


@query("state_merge_full", f"""WITH {FRAMES}, a AS (SELECT session, frame, zone FROM f WHERE k < 60), b AS (SELECT session, frame, CASE WHEN k % 7 = 0 THEN 'other' ELSE zone END AS zone FROM f WHERE k >= 40)
SELECT coalesce(a.session, b.session) AS session, coalesce(a.frame, b.frame) AS frame, coalesce(a.zone, b.zone) AS zone, CASE WHEN a.zone IS NOT NULL AND b.zone IS NOT NULL THEN a.zone = b.zone END AS agree FROM a FULL JOIN b ON a.session = b.session AND a.frame = b.frame""")
def state_merge_full(spark, sf_dir):
    f = frames(spark, sf_dir)
    other = f.where("k >= 40").withColumn("zone", F.when(F.col("k") % 7 == 0, "other").otherwise(F.col("zone")))
    return joins.merged_states(f.where("k < 60"), other, ["session", "frame"], "zone").select("session", "frame", "zone", "agree")


@query("frame_align", f"""WITH {FRAMES}, n AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY frame) - 1 AS number, t_us FROM f), m AS (SELECT session, number, t_us/1000.0 AS ms FROM n WHERE number < 20 AND session % 5 <> 0),
h AS (SELECT session, true AS has FROM m GROUP BY session)
SELECT n.session, n.number, round(CASE WHEN has THEN ms ELSE n.number * 1000.0 / 30 END, 3) AS ms FROM n LEFT JOIN m USING (session, number) LEFT JOIN h ON n.session = h.session""")
def frame_align(spark, sf_dir):
    n = frames(spark, sf_dir).withColumn("number", (F.row_number().over(series.along()) - 1).cast("long"))
    measured = n.where("number < 20 AND session % 5 <> 0").select("session", "number", (F.col("t_us") / 1000.0).alias("ms"))
    return joins.aligned(n.select("session", "number"), measured, "number", "ms", fps=30.0).select("session", "number", F.round("ms", 3).alias("ms"))


@query("cohort_attach", """WITH sheet AS (SELECT o_custkey::VARCHAR AS subject, o_orderpriority AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey::VARCHAR AS subject, c_mktsegment AS segment, grp FROM customer LEFT JOIN sheet ON c_custkey::VARCHAR = subject AND rn = 1""")
def cohort_attach(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"))
    sheet = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("grp"), "o_orderkey")
    return joins.attached(rows, sheet, "subject", "o_orderkey")


@query("pairing_ladder", """WITH a AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS seg FROM customer), b AS (SELECT s_suppkey AS sid, s_nationkey AS n FROM supplier),
t AS (SELECT id, sid, 0 AS tier FROM a JOIN b ON id = sid AND a.n = b.n UNION ALL SELECT id, sid, 1 FROM a JOIN b ON id = sid UNION ALL SELECT id, sid, 2 FROM a JOIN b ON a.n = b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, sid) AS rn FROM t) SELECT id, sid, tier FROM r WHERE rn = 1""")
def pairing_ladder(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_nationkey").alias("n"))
    return joins.laddered(a, b, "id", "sid", [[("id", "sid"), ("n", "n")], [("id", "sid")], [("n", "n")]])


@query("orphans_anti", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans_anti(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return joins.unmatched(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), known, "id")


@query("unsampled_states", f"WITH {FRAMES} SELECT DISTINCT session, zone FROM f WHERE k >= 50 EXCEPT SELECT session, zone FROM f WHERE k < 50")
def unsampled_states(spark, sf_dir):
    f = frames(spark, sf_dir)
    return joins.unmatched(f.where("k >= 50").select("session", "zone").distinct(), f.where("k < 50"), "session", "zone")


@query("id_names", "SELECT c_custkey AS id, c_nationkey AS nation, coalesce(n_name, c_nationkey::VARCHAR) AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def id_names(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return joins.named(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), names, "nation", "name").select("id", "nation", "name")


@query("parity_keypoints", f"""WITH {FRAMES}, a AS (SELECT session, frame, speed AS x, k AS y FROM f WHERE k < 80), b AS (SELECT session, frame, speed + 1 AS x, k + (frame % 3) AS y FROM f WHERE k >= 20),
j AS (SELECT a.frame AS fa, b.frame AS fb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS far FROM a FULL JOIN b ON a.session = b.session AND a.frame = b.frame)
SELECT count(*) FILTER (WHERE fa IS NOT NULL AND fb IS NOT NULL) AS shared, count(*) FILTER (WHERE fb IS NULL) AS only_a, count(*) FILTER (WHERE fa IS NULL) AS only_b, round(avg(far), 5) AS mean_px, round(quantile_cont(far, 0.95), 5) AS p95_px, round(max(far), 5) AS max_px FROM j""")
def parity_keypoints(spark, sf_dir):
    f = frames(spark, sf_dir)
    b = f.where("k >= 20").select("session", "frame", (F.col("x") + 1).alias("x"), (F.col("y") + F.col("frame") % 3).alias("y"))
    p = joins.parity(f.where("k < 80"), b, ["session", "frame"])
    return p.withColumns({c: F.round(c, 5) for c in ("mean_px", "p95_px", "max_px")})


@query("interval_fold", f"""WITH {FRAMES}, p AS (SELECT session, frame, t_us FROM f WHERE k < 30), ev AS (SELECT session, frame AS ord, t_us, zone FROM f WHERE k >= 70),
a AS (SELECT ev.session, ev.ord, ev.t_us, ev.zone, p.frame FROM ev ASOF LEFT JOIN p ON ev.session = p.session AND ev.t_us >= p.t_us),
m AS (SELECT session, min(frame) AS first FROM p GROUP BY session),
g AS (SELECT a.session, coalesce(a.frame, m.first) AS frame, string_agg(a.zone, '|' ORDER BY a.t_us, a.ord) AS names FROM a JOIN m USING (session) GROUP BY ALL)
SELECT p.session, p.frame, coalesce(names, '') AS names FROM p LEFT JOIN g ON p.session = g.session AND p.frame = g.frame""")
def interval_fold(spark, sf_dir):
    f = frames(spark, sf_dir)
    return joins.folded(f.where("k < 30").select("session", "frame", "t_us"), f.where("k >= 70").select("session", "t_us", "zone", F.col("frame")), "t_us", "zone", "frame").select("session", "frame", "names")


@query("union_logs", f"WITH {FRAMES} SELECT session, frame, zone, NULL::DOUBLE AS speed FROM f WHERE k < 10 UNION ALL SELECT session, frame, NULL, speed FROM f WHERE k > 90")
def union_logs(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where("k < 10").select("session", "frame", "zone").unionByName(f.where("k > 90").select("session", "frame", "speed"), allowMissingColumns=True)


@query("shared_keys", f"WITH {FRAMES} SELECT session FROM f WHERE k < 3 INTERSECT SELECT session FROM f WHERE k > 97")
def shared_keys(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where("k < 3").select("session").intersect(f.where("k > 97").select("session"))
