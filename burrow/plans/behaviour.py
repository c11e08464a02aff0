"""Queries of time, distance, visits, bins, states and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.operators import bins, measures, rollup, series
from burrow.plans.registry import FRAMES, RUNS, frames, query, table

HOUR = 3_600_000_000


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with intervals and steps between (x, y)."""
    return series.steps(series.intervals(frames(spark, sf_dir).withColumn("given_speed", F.col("speed"))))


@query("zone_dwell", f"WITH {FRAMES}, {RUNS} SELECT session, zone, round(sum(time_us)/1e6, 3) AS dwell_s, count(*) AS visits, round(max(time_us)/1e6, 3) AS longest_s FROM s GROUP BY ALL")
def zone_dwell(spark, sf_dir):
    s = series.spans(series.intervals(frames(spark, sf_dir)), "zone")
    return s.groupBy("session", "zone").agg(F.round(F.sum("time_us") / 1e6, 3).alias("dwell_s"), F.count("*").alias("visits"), F.round(F.max("time_us") / 1e6, 3).alias("longest_s"))


@query("session_totals", f"""WITH {FRAMES}, v AS (SELECT *, CASE WHEN dt_us > 0 THEN step*1e6/dt_us ELSE 0 END AS sp FROM d)
SELECT session, round(sum(dt_us)/1e6, 3) AS duration_s, round(sum(step), 3) AS path, round(CASE WHEN sum(dt_us) > 0 THEN sum(step)/(sum(dt_us)/1e6) ELSE 0 END, 5) AS mean_rate, round(max(sp), 4) AS peak_rate FROM v GROUP BY session""")
def session_totals(spark, sf_dir):
    t = measures.totals(walked(spark, sf_dir))
    return t.select("session", F.round("duration_s", 3).alias("duration_s"), F.round("path", 3).alias("path"), F.round("mean_rate", 5).alias("mean_rate"), F.round("peak_rate", 4).alias("peak_rate"))


@query("zone_totals", f"""WITH {FRAMES} SELECT session, zone, round(sum(dt_us)/1e6, 3) AS duration_s, round(sum(step), 3) AS path, round(CASE WHEN sum(dt_us) > 0 THEN sum(step)/(sum(dt_us)/1e6) ELSE 0 END, 5) AS mean_rate FROM d GROUP BY session, zone""")
def zone_totals(spark, sf_dir):
    t = measures.totals(walked(spark, sf_dir), "session", "zone")
    return t.select("session", "zone", F.round("duration_s", 3).alias("duration_s"), F.round("path", 3).alias("path"), F.round("mean_rate", 5).alias("mean_rate"))


@query("masked_totals", f"""WITH {FRAMES} SELECT session, round(coalesce(sum(dt_us) FILTER (WHERE k >= 50), 0)/1e6, 3) AS duration_s, round(coalesce(sum(step) FILTER (WHERE k >= 50), 0), 3) AS path FROM d GROUP BY session""")
def masked_totals(spark, sf_dir):
    t = measures.totals(walked(spark, sf_dir), where=F.col("k") >= 50)
    return t.select("session", F.round("duration_s", 3).alias("duration_s"), F.round("path", 3).alias("path"))


@query("reset_safe_clock", """WITH f AS (SELECT user_id AS session, event_id AS frame, epoch_us(ts) % 3600000000 AS t_us FROM events),
g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY session ORDER BY frame) AS raw FROM f),
m AS (SELECT session, quantile_cont(raw, 0.5) FILTER (WHERE raw > 0) AS med FROM g GROUP BY session)
SELECT session, count(*) FILTER (WHERE raw < 0) AS resets, round(sum(CASE WHEN raw < 0 THEN coalesce(med, 33000) ELSE coalesce(raw, 0) END)/1e6, 2) AS duration_s FROM g JOIN m USING (session) GROUP BY session""")
def reset_safe_clock(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("t_us", F.col("t_us") % HOUR)
    d = series.reset_safe_intervals(f).withColumn("raw", F.col("t_us") - F.lag("t_us").over(series.along()))
    return d.groupBy("session").agg(F.count(F.when(F.col("raw") < 0, 1)).alias("resets"), F.round(F.sum("dt_us") / 1e6, 2).alias("duration_s"))


_VISITS = f"""WITH {FRAMES}, z AS (SELECT session, frame, dt_us, coalesce(zone = 'click', false) AS ins FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR ins = lag(ins) OVER w THEN 0 ELSE 1 END AS ch, sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el FROM z WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT session, run, ins, max(frame) AS lf, count(*) AS n, sum(dt_us) AS t, min(el - dt_us) AS st FROM r GROUP BY ALL),
e AS (SELECT session, max(frame) AS ef FROM d GROUP BY session),
q AS (SELECT s.*, ef, ins AND t >= 60000000 AND %s AS ok FROM s JOIN e USING (session))
SELECT session, count(*) FILTER (WHERE ok) AS entries, count(*) FILTER (WHERE ok AND lf < ef) AS exits, min(st) FILTER (WHERE ok) AS latency_us, coalesce(sum(t) FILTER (WHERE ins), 0)::BIGINT AS total_us, coalesce(sum(t) FILTER (WHERE ok), 0)::BIGINT AS visit_us FROM q GROUP BY session"""


def _visits(variant: str):
    def run(spark, sf_dir):
        v = measures.visits(series.intervals(frames(spark, sf_dir)), F.col("zone") == "click", 60_000_000, variant)
        return v.select("session", "entries", "exits", F.col("latency_us").cast("long").alias("latency_us"), F.col("total_us").cast("long").alias("total_us"), F.col("visit_us").cast("long").alias("visit_us"))

    return run


query("dwell_entries_a", _VISITS % "n >= 2")(_visits("a"))
query("dwell_entries_b", _VISITS % "true")(_visits("b"))
query("dwell_entries_c", _VISITS % "n >= 2")(_visits("c"))


@query("zone_visits", f"""WITH {FRAMES}, {RUNS} SELECT session, zone, count(*) FILTER (WHERE time_us >= 60000000 AND n >= 2) AS entries, min(start_us) FILTER (WHERE time_us >= 60000000 AND n >= 2) AS latency_us, sum(time_us)::BIGINT AS total_us, max(time_us) FILTER (WHERE time_us >= 60000000 AND n >= 2) AS longest_us FROM s GROUP BY ALL""")
def zone_visits(spark, sf_dir):
    return measures.zone_visits(series.intervals(frames(spark, sf_dir)), "zone", 60_000_000)


@query("still_bouts", f"""WITH {FRAMES}, z AS (SELECT session, frame, dt_us, coalesce(speed < 10, false) AS ins FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR ins = lag(ins) OVER w THEN 0 ELSE 1 END AS ch, sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el FROM z WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT session, run, ins, sum(dt_us) AS t, min(el - dt_us) AS st FROM r GROUP BY ALL)
SELECT session, coalesce(sum(t) FILTER (WHERE ins AND t >= 300000000), 0)::BIGINT AS still_us, count(*) FILTER (WHERE ins AND t >= 300000000) AS bouts, min(st) FILTER (WHERE ins AND t >= 300000000) AS latency_us FROM s GROUP BY session""")
def still_bouts(spark, sf_dir):
    return measures.still_bouts(series.intervals(frames(spark, sf_dir)), "speed", 10.0, 300_000_000)


@query("transitions_total", f"""WITH {FRAMES}, z AS (SELECT *, lag(zone) OVER (PARTITION BY session ORDER BY frame) AS b FROM d WHERE zone IS NOT NULL AND zone NOT IN ('', 'na', 'none', 'None', '-')),
n AS (SELECT session, count(*) FILTER (WHERE b <> zone) AS n FROM z GROUP BY session) SELECT s.session, coalesce(n, 0) AS transitions FROM (SELECT DISTINCT session FROM d) s LEFT JOIN n USING (session)""")
def transitions_total(spark, sf_dir):
    return measures.transitions_total(frames(spark, sf_dir), "zone")


@query("transitions_some_zones", f"""WITH {FRAMES}, z AS (SELECT *, lag(zone) OVER (PARTITION BY session ORDER BY frame) AS b FROM d WHERE zone IN ('click', 'view')),
n AS (SELECT session, count(*) FILTER (WHERE b <> zone) AS n FROM z GROUP BY session) SELECT s.session, coalesce(n, 0) AS transitions FROM (SELECT DISTINCT session FROM d) s LEFT JOIN n USING (session)""")
def transitions_some_zones(spark, sf_dir):
    return measures.transitions_total(frames(spark, sf_dir), "zone", ("click", "view"))


@query("transition_matrix", f"""WITH {FRAMES}, z AS (SELECT *, lag(zone) OVER (PARTITION BY session ORDER BY frame) AS b FROM d WHERE zone IS NOT NULL AND zone NOT IN ('', 'na', 'none', 'None', '-'))
SELECT session, b AS from_zone, zone AS to_zone, count(*) AS n FROM z WHERE b <> zone GROUP BY ALL""")
def transition_matrix(spark, sf_dir):
    return measures.transition_matrix(frames(spark, sf_dir), "zone")


@query("stage_transition_matrix", f"""WITH {FRAMES}, g AS (SELECT *, CASE WHEN k < 34 THEN 'low' WHEN k < 67 THEN 'mid' ELSE 'high' END AS stage FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR stage = lag(stage) OVER w THEN 0 ELSE 1 END AS ch FROM g WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
z AS (SELECT *, lag(zone) OVER (PARTITION BY session, run ORDER BY frame) AS b FROM r WHERE zone IS NOT NULL AND zone NOT IN ('', 'na', 'none', 'None', '-'))
SELECT session, stage, b AS from_zone, zone AS to_zone, count(*) AS n FROM z WHERE b <> zone GROUP BY ALL""")
def stage_transition_matrix(spark, sf_dir):
    return measures.transition_matrix(frames(spark, sf_dir).withColumn("stage", F.when(F.col("k") < 34, "low").when(F.col("k") < 67, "mid").otherwise("high")), "zone", "stage")


@query("alternation", f"""WITH {FRAMES}, {RUNS}, w AS (SELECT *, lag(zone, 1) OVER (PARTITION BY session ORDER BY first_frame) AS a, lag(zone, 2) OVER (PARTITION BY session ORDER BY first_frame) AS b FROM s WHERE zone IS NOT NULL)
SELECT session, count(*) AS triads, count(*) FILTER (WHERE zone <> a AND a <> b AND zone <> b) AS alternations, round(100.0 * count(*) FILTER (WHERE zone <> a AND a <> b AND zone <> b) / count(*), 4) AS alternation_pct FROM w WHERE b IS NOT NULL GROUP BY session""")
def alternation(spark, sf_dir):
    return measures.alternation(frames(spark, sf_dir), "zone").withColumn("alternation_pct", F.round("alternation_pct", 4))


@query("preference", f"""WITH {FRAMES}, p AS (SELECT session, coalesce(sum(dt_us) FILTER (WHERE zone = 'view'), 0)::BIGINT AS n, coalesce(sum(dt_us) FILTER (WHERE zone = 'click'), 0)::BIGINT AS f FROM d GROUP BY session)
SELECT session, n AS novel_us, f AS familiar_us, CASE WHEN n + f > 0 THEN round((n - f) / (n + f), 6) END AS preference, CASE WHEN n + f > 0 THEN round(100.0 * n / (n + f), 5) END AS percent FROM p""")
def preference(spark, sf_dir):
    p = measures.preference(series.intervals(frames(spark, sf_dir)), "zone", "view", "click")
    return p.withColumns({"preference": F.round("preference", 6), "percent": F.round("percent", 5)})


@query("regions", f"""WITH {FRAMES} SELECT session, 'active' AS region, coalesce(sum(dt_us) FILTER (WHERE zone IN ('click', 'purchase')), 0)::BIGINT AS total_us FROM d GROUP BY session
UNION ALL SELECT session, 'passive', coalesce(sum(dt_us) FILTER (WHERE zone IN ('view', 'error')), 0)::BIGINT FROM d GROUP BY session""")
def regions(spark, sf_dir):
    return measures.regions(series.intervals(frames(spark, sf_dir)), "zone", {"active": ["click", "purchase"], "passive": ["view", "error"]})


@query("cumulative_distance", f"""WITH {FRAMES} SELECT session, frame, round(sum(step) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING), 3) AS distance FROM d""")
def cumulative_distance(spark, sf_dir):
    return measures.cumulative(walked(spark, sf_dir)).select("session", "frame", F.round("distance", 3).alias("distance"))


@query("stage_spans", f"WITH {FRAMES}, {RUNS} SELECT session, run::BIGINT AS run, zone, first_frame, last_frame, n AS frames, time_us::BIGINT AS time_us, start_us::BIGINT AS start_us FROM s")
def stage_spans(spark, sf_dir):
    return series.spans(series.intervals(frames(spark, sf_dir)), "zone")


@query("state_rows_grouped", f"WITH {FRAMES} SELECT session, zone, count(*) AS frames, round(sum(dt_us)/1e6, 3) AS duration_s, round(sum(step), 3) AS path, min(frame) AS first_frame FROM d WHERE zone IS NOT NULL GROUP BY ALL")
def state_rows_grouped(spark, sf_dir):
    return measures.state_rows(walked(spark, sf_dir), "zone").withColumns({"duration_s": F.round("duration_s", 3), "path": F.round("path", 3)})


@query("state_rows_spans", f"WITH {FRAMES}, {RUNS} SELECT session, run::BIGINT AS run, zone, count(*) AS frames, round((max(t_us) - min(t_us))/1e6, 3) AS duration_s, min(frame) AS first_frame FROM r GROUP BY session, run, zone HAVING count(*) >= 2")
def state_rows_spans(spark, sf_dir):
    return measures.span_rows(frames(spark, sf_dir), "zone").withColumn("duration_s", F.round("duration_s", 3))


@query("interleave_flag", f"WITH {FRAMES}, {RUNS} SELECT session, count(*) AS spans, count(DISTINCT zone) AS names, count(*) >= 3 * count(DISTINCT zone) AS interleaved FROM s WHERE zone IS NOT NULL AND zone <> '' GROUP BY session")
def interleave_flag(spark, sf_dir):
    return measures.interleaved(frames(spark, sf_dir), "zone")


def _binned(spark, sf_dir):
    return series.elapsed(walked(spark, sf_dir))


@query("time_bins_width", f"""WITH {FRAMES}, e AS (SELECT *, sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el FROM d),
b AS (SELECT session, floor(el/86400000000)::BIGINT AS bin, count(*) AS frames, sum(dt_us) AS cov, sum(step) AS path FROM e GROUP BY ALL)
SELECT session, bin, (bin*86400) || '-' || ((bin+1)*86400) || 's' AS label, frames, round(cov/1e6, 3) AS covered_s, round(path, 3) AS path, round(CASE WHEN cov > 0 THEN path/(cov/1e6) ELSE 0 END, 5) AS mean_rate, cov < 0.95*86400000000 AS partial FROM b""")
def time_bins_width(spark, sf_dir):
    r = bins.rows(_binned(spark, sf_dir), 24 * HOUR)
    return r.withColumns({"covered_s": F.round("covered_s", 3), "path": F.round("path", 3), "mean_rate": F.round("mean_rate", 5)})


@query("time_bins_count", f"""WITH {FRAMES}, e AS (SELECT *, sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el FROM d),
z AS (SELECT *, greatest(ceil(ceil(max(el) OVER (PARTITION BY session)/1e6)/4), 1) AS size FROM e)
SELECT session, least(floor(el/(size*1000000)), 3)::BIGINT AS bin, count(*) AS frames, round(sum(dt_us)/1e6, 3) AS covered_s FROM z GROUP BY ALL""")
def time_bins_count(spark, sf_dir):
    b = bins.by_count(_binned(spark, sf_dir), 4)
    return b.groupBy("session", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("frames"), F.round(F.sum("dt_us") / 1e6, 3).alias("covered_s"))


@query("time_bins_edges", f"""WITH {FRAMES}, e AS (SELECT *, sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el FROM d)
SELECT session, ((el >= 86400000000)::INT + (el >= 432000000000)::INT) AS bin, count(*) AS frames, round(sum(dt_us)/1e6, 3) AS covered_s FROM e GROUP BY ALL""")
def time_bins_edges(spark, sf_dir):
    b = bins.by_edges(_binned(spark, sf_dir), [24 * HOUR, 120 * HOUR])
    return b.groupBy("session", "bin").agg(F.count("*").alias("frames"), F.round(F.sum("dt_us") / 1e6, 3).alias("covered_s"))


@query("bin_zone_entries", f"""WITH {FRAMES}, e AS (SELECT *, floor(sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING)/86400000000)::BIGINT AS bin FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (zone IS NOT DISTINCT FROM lag(zone) OVER w AND bin = lag(bin) OVER w) THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT session, run, bin, zone, sum(dt_us) AS t, count(*) AS n FROM r GROUP BY ALL)
SELECT session, bin, zone, sum(t)::BIGINT AS total_us, count(*) FILTER (WHERE t >= 60000000 AND n >= 2) AS entries FROM s GROUP BY session, bin, zone""")
def bin_zone_entries(spark, sf_dir):
    return bins.zone_entries(_binned(spark, sf_dir), "zone", 24 * HOUR, 60_000_000)


@query("state_time_bins", f"""WITH {FRAMES}, b AS (SELECT *, floor((t_us - min(t_us) OVER (PARTITION BY session, zone))/86400000000)::BIGINT AS bin FROM d WHERE zone IS NOT NULL)
SELECT session, zone, bin, sum(dt_us)::BIGINT AS total_us FROM b GROUP BY ALL""")
def state_time_bins(spark, sf_dir):
    return bins.per_state(series.intervals(frames(spark, sf_dir)), "zone", 24 * HOUR)


@query("both_endpoint_distance", f"""WITH {FRAMES}, m AS (SELECT session, step, k >= 50 AS ins, lag(k >= 50) OVER (PARTITION BY session ORDER BY frame) AS was FROM d)
SELECT session, round(coalesce(sum(step) FILTER (WHERE ins AND was), 0), 3) AS both_path, round(coalesce(sum(step) FILTER (WHERE ins), 0), 3) AS arrival_path FROM m GROUP BY session""")
def both_endpoint_distance(spark, sf_dir):
    w = walked(spark, sf_dir).withColumn("ins", F.col("k") >= 50).withColumn("was", F.lag("ins").over(series.along()))
    total = lambda c: F.round(F.sum(F.when(c, F.col("step")).otherwise(0.0)), 3)
    return w.groupBy("session").agg(total(F.col("ins") & F.col("was")).alias("both_path"), total(F.col("ins")).alias("arrival_path"))


@query("rule_edges", f"""WITH {FRAMES}, a AS (SELECT *, coalesce(speed > 20, false) AS act FROM d) SELECT session, frame FROM (SELECT *, coalesce(lag(act) OVER (PARTITION BY session ORDER BY frame), false) AS was FROM a) WHERE act AND NOT was""")
def rule_edges(spark, sf_dir):
    return series.rising(frames(spark, sf_dir), F.col("speed") > 20).where("fired").select("session", "frame")


@query("held_condition", f"""WITH {FRAMES}, z AS (SELECT session, frame, dt_us, coalesce(speed > 8, false) AS ins FROM d),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR ins = lag(ins) OVER w THEN 0 ELSE 1 END AS ch FROM z WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
h AS (SELECT *, ins AND sum(dt_us) OVER (PARTITION BY session, run ORDER BY frame ROWS UNBOUNDED PRECEDING) >= 60000000 AS held FROM r)
SELECT session, count(*) FILTER (WHERE held) AS frames, coalesce(sum(dt_us) FILTER (WHERE held), 0)::BIGINT AS held_us FROM h GROUP BY session""")
def held_condition(spark, sf_dir):
    h = series.held(series.intervals(frames(spark, sf_dir)), F.col("speed") > 8, 60_000_000)
    return h.groupBy("session").agg(F.count(F.when(F.col("held"), 1)).alias("frames"), F.sum(F.when(F.col("held"), F.col("dt_us")).otherwise(0)).alias("held_us"))


@query("group_summary", """WITH l AS (SELECT c_mktsegment AS seg, n_name AS nation, 'balance' AS measure, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT seg, nation, measure, count(*) AS rows, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd, round(CASE WHEN count(v) > 0 THEN stddev_samp(v)/sqrt(count(v)) END, 3) AS sem FROM l GROUP BY ALL""")
def group_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("seg"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"))
    g = rollup.group_summary(c, ["seg", "nation"], ["balance"])
    return g.select("seg", "nation", "measure", "rows", "n", *(F.round(x, 3).alias(x) for x in ("mean", "sd", "sem")))


@query("latency_percentiles", """WITH r AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events WHERE value IS NOT NULL AND value >= 0 AND value <= 10000)
SELECT stage, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM r WHERE rn <= 240 GROUP BY stage""")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage")
    r = rollup.latency_summary(e, "stage", "value", "event_id")
    return r.select("stage", "n", *(F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "p99")))


@query("deadline_misses", """SELECT event_type AS stage, count(*) FILTER (WHERE value > 25) AS missed, round(count(*) FILTER (WHERE value > 25)/count(*), 6) AS missed_share, round(max(value - 25) FILTER (WHERE value > 25), 4) AS worst_over FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def deadline_misses(spark, sf_dir):
    r = rollup.deadline_misses(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), "stage", "value", 25.0)
    return r.withColumns({"missed_share": F.round("missed_share", 6), "worst_over": F.round("worst_over", 4)})


@query("clock_stats", f"""WITH {FRAMES}, g AS (SELECT session, t_us/1000.0 - lag(t_us/1000.0) OVER (PARTITION BY session ORDER BY frame) AS dd FROM d),
a AS (SELECT session, quantile_cont(dd, 0.5) FILTER (WHERE dd > 0) AS med, stddev_pop(dd) FILTER (WHERE dd > 0) AS sd, count(*) FILTER (WHERE dd < 0) AS backward FROM g GROUP BY session)
SELECT session, round(med, 2) AS median_ms, CASE WHEN med > 0 THEN round(1000.0/med, 8) END AS fps, sd > 0.05*med AS variable, backward FROM a""")
def clock_stats(spark, sf_dir):
    r = rollup.clock_stats(frames(spark, sf_dir).withColumn("ms", F.col("t_us") / 1000.0), "ms")
    return r.select("session", F.round("median_ms", 2).alias("median_ms"), F.round("fps", 8).alias("fps"), "variable", "backward")


@query("top_prints", "SELECT zone, n FROM (SELECT event_type AS zone, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, zone LIMIT 3)")
def top_prints(spark, sf_dir):
    return rollup.top_n(frames(spark, sf_dir), "zone", 3)


@query("stream_counts", "SELECT event_type AS stream, count(*) AS drops, round(max(value), 4) AS worst FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stream")).agg(F.count("*").alias("drops"), F.round(F.max("value"), 4).alias("worst"))
