"""Queries of session rows, look-ups by path and what a running rig computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import names
from burrow.operators import joins, live, series, session_rows, zones
from burrow.plans.registry import FRAMES, frames, query, table
from burrow.scratch import scratch
from burrow.plans.space import ZONES, _inside, zone_table
from burrow.sources import reports

_ZONES = ("click", "view", "error")


def _steps(spark, sf_dir):
    return series.steps(series.intervals(frames(spark, sf_dir)))


_WIDE = ", ".join(f"round(sum(CASE WHEN zone = '{z}' THEN dt_us ELSE 0 END)/1e6, 4) AS {z}_time_s, count(*) FILTER (WHERE zone = '{z}' AND was IS DISTINCT FROM '{z}') AS {z}_entries" for z in _ZONES)
_DIST = ", ".join(f"round(sum(CASE WHEN zone = '{z}' THEN step ELSE 0 END)/1200, 4) AS {z}_distance_m" for z in _ZONES)
_LAG = "w AS (SELECT *, lag(zone) OVER (PARTITION BY session ORDER BY frame) AS was, CASE WHEN dt_us > 0 THEN step*1e6/dt_us ELSE 0 END AS v FROM d)"


@query("session_rows", f"""WITH {FRAMES}, {_LAG} SELECT session, ceil(sum(dt_us)/1e6)::BIGINT AS "Duration_s", round(sum(step)/1200, 4) AS "Distance_m", round(sum(step)/(sum(dt_us)/1e6)/1200, 4) AS "Mean_Speed_m_s", round(max(v)/1200, 4) AS "Max_Speed_m_s",
count(*) FILTER (WHERE zone <> was) AS "Transitions_total", {_WIDE}, {_DIST} FROM w GROUP BY session""")
def rows_of_sessions(spark, sf_dir):
    return session_rows.session_row(_steps(spark, sf_dir), list(_ZONES), px_per_cm=12.0)


@query("unposed_rows", f"""WITH {FRAMES}, {_LAG} SELECT session, ceil(sum(dt_us)/1e6)::BIGINT AS "Duration_s", count(*) FILTER (WHERE zone <> was) AS "Transitions_total", {_WIDE} FROM w GROUP BY session""")
def unposed_rows(spark, sf_dir):
    """What sessions without a pose still tell."""
    return session_rows.session_row(_steps(spark, sf_dir), list(_ZONES), px_per_cm=12.0, has_pose=False)


@query("locomotion_px", f"""WITH {FRAMES}, {_LAG} SELECT session, ceil(sum(dt_us)/1e6)::BIGINT AS "Duration_s", round(sum(step), 4) AS "Distance_px", round(sum(step)/(sum(dt_us)/1e6), 4) AS "Mean_Speed_px_s", round(max(v), 4) AS "Max_Speed_px_s" FROM w GROUP BY session""")
def locomotion_px(spark, sf_dir):
    return session_rows.session_row(_steps(spark, sf_dir), [], session_rows.Flags(transitions=False))


_REGIONS = {"shop": ["click", "purchase"], "all": ["click", "view", "purchase"]}
_NAMES = [*_ZONES, *_REGIONS]
_CUTS = {"Immobile": 0.006, "Freezing": 0.003}


def _still(i: int, below: float) -> str:
    return f"""k{i} AS (SELECT *, v < {below} AS still, el - dt_us AS st FROM v), c{i} AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR still = lag(still) OVER w THEN 0 ELSE 1 END AS ch FROM k{i} WINDOW w AS (PARTITION BY session ORDER BY frame)),
r{i} AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c{i}), g{i} AS (SELECT session, run, still, sum(dt_us) AS us, min(st) AS st FROM r{i} GROUP BY ALL),
s{i} AS (SELECT session, coalesce(sum(us) FILTER (WHERE still AND us >= 40000000000), 0) AS us, count(*) FILTER (WHERE still AND us >= 40000000000) AS n, min(st) FILTER (WHERE still AND us >= 40000000000) AS lat FROM g{i} GROUP BY session)"""


def _visit_cells() -> str:
    one = "max(q.{c}) FILTER (WHERE q.name = '{n}' AND q.kind = '{k}')"
    out = []
    for n in _NAMES:
        p = lambda c, k="body", n=n: one.format(c=c, n=n, k=k)
        out.append(f"""((coalesce({p('us')}, 0) + 50)//100)::BIGINT/10000.0::DOUBLE AS {n}_time_s, coalesce({p('ent')}, 0) AS {n}_entries, coalesce({p('ex')}, 0) AS {n}_exits, (({p('lat')} + 50)//100)::BIGINT/10000.0::DOUBLE AS {n}_latency_s, round(coalesce({p('vis')}/nullif({p('ent')}, 0)/1e6, 0), 4) AS {n}_mean_visit_s,
((coalesce({p('us', 'head')}, 0) + 50)//100)::BIGINT/10000.0::DOUBLE AS {n}_time_head_s, coalesce({p('ent', 'head')}, 0) AS {n}_entries_head""")
    return ",\n".join(out)


@query("detailed_rows", f"""WITH {FRAMES}, v AS (SELECT *, CASE WHEN dt_us > 0 THEN step*1e6/dt_us ELSE 0 END AS v, sum(dt_us) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS el, CASE WHEN k % 3 = 0 THEN zone WHEN k % 3 = 1 THEN 'view' END AS hz, row_number() OVER (PARTITION BY session ORDER BY frame) AS i, count(*) OVER (PARTITION BY session) AS n FROM d),
{_still(0, _CUTS["Immobile"])}, {_still(1, _CUTS["Freezing"])},
m AS (SELECT session, i, n, dt_us, el, 'body' AS kind, unnest(list_filter([zone, CASE WHEN zone IN ('click', 'purchase') THEN 'shop' END, CASE WHEN zone IN ('click', 'view', 'purchase') THEN 'all' END], lambda x: x IS NOT NULL)) AS name FROM v
UNION ALL SELECT session, i, n, dt_us, el, 'head', unnest(list_filter([hz, CASE WHEN hz IN ('click', 'purchase') THEN 'shop' END, CASE WHEN hz IN ('click', 'view', 'purchase') THEN 'all' END], lambda x: x IS NOT NULL)) FROM v),
u AS (SELECT *, i - row_number() OVER (PARTITION BY session, kind, name ORDER BY i) AS run FROM m), z AS (SELECT session, kind, name, run, sum(dt_us) AS us, count(*) AS c, max(i) AS fin, any_value(n) AS n, min(el - dt_us) AS st FROM u GROUP BY ALL),
q AS (SELECT session, kind, name, sum(us) AS us, count(*) FILTER (WHERE c >= 2 AND us >= 60000000000) AS ent, count(*) FILTER (WHERE c >= 2 AND us >= 60000000000 AND fin < n) AS ex, min(st) FILTER (WHERE c >= 2 AND us >= 60000000000) AS lat, sum(us) FILTER (WHERE c >= 2 AND us >= 60000000000) AS vis FROM z GROUP BY ALL),
f2 AS (SELECT session, sum(dt_us) FILTER (WHERE zone = 'click') AS a, sum(dt_us) FILTER (WHERE zone = 'view') AS b FROM d GROUP BY session)
SELECT s0.session, ((any_value(s0.us) + 50)//100)::BIGINT/10000.0::DOUBLE AS "Immobile_time_s", any_value(s0.n) AS "Immobile_bouts", ((any_value(s1.us) + 50)//100)::BIGINT/10000.0::DOUBLE AS "Freezing_time_s", any_value(s1.n) AS "Freezing_episodes", ((any_value(s1.lat) + 50)//100)::BIGINT/10000.0::DOUBLE AS "Freezing_latency_s",
round(any_value((coalesce(a, 0) - coalesce(b, 0))/nullif(coalesce(a, 0) + coalesce(b, 0), 0)), 4) AS "Preference", round(any_value(100.0*coalesce(a, 0)/nullif(coalesce(a, 0) + coalesce(b, 0), 0)), 4) AS "Preference_pct",
{_visit_cells()} FROM s0 JOIN s1 USING (session) JOIN f2 USING (session) LEFT JOIN q USING (session) GROUP BY s0.session""")
def detailed_rows(spark, sf_dir):
    """Bouts, visits of zones and regions by body and head, and preference, one row a session."""
    d = _steps(spark, sf_dir).withColumn("head_zone", F.when(F.col("k") % 3 == 0, F.col("zone")).when(F.col("k") % 3 == 1, "view"))
    return session_rows.detailed_row(d, list(_ZONES), _REGIONS, immobile_cm_s=_CUTS["Immobile"], freeze_cm_s=_CUTS["Freezing"], least_still_us=40_000_000_000, least_us=60_000_000_000, novel="click", familiar="view")


_SHAPE = f"""{FRAMES}, s AS (SELECT session, frame, CASE WHEN session % 3 = 0 THEN zone WHEN session % 3 = 1 AND frame % 1000 < 500 THEN 'first' WHEN session % 3 = 1 THEN 'second' END AS stage FROM f),
c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND stage IS NOT DISTINCT FROM lag(stage) OVER w THEN 0 ELSE 1 END AS ch FROM s WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS span FROM c),
g AS (SELECT session, span, any_value(stage) AS stage, count(*) AS n, min(frame) AS first FROM r GROUP BY session, span),
k AS (SELECT *, count(*) FILTER (WHERE stage IS NOT NULL) OVER (PARTITION BY session) AS named, count(*) FILTER (WHERE stage IS NOT NULL AND n >= 2) OVER (PARTITION BY session) AS long FROM g)"""


@query("row_shapes", f"""WITH {_SHAPE} SELECT session, CASE WHEN named >= 2 AND long > 0 THEN stage ELSE '' END AS "Stage", CASE WHEN named >= 2 AND long > 0 THEN first ELSE 0 END AS opened, sum(n)::BIGINT AS frames FROM k
WHERE NOT (named >= 2 AND long > 0) OR (stage IS NOT NULL AND n >= 2) GROUP BY ALL""")
def row_shapes(spark, sf_dir):
    k = F.col("session") % 3
    stage = F.when(k == 0, F.col("zone")).when((k == 1) & (F.col("frame") % 1000 < 500), "first").when(k == 1, "second")
    d = session_rows.shaped(frames(spark, sf_dir).withColumn("stage", stage))
    return d.groupBy("session", "span", "Stage").agg(F.min("frame").alias("opened"), F.count("*").alias("frames")).select("session", "Stage", F.when(F.col("span") == 0, 0).otherwise(F.col("opened")).alias("opened"), "frames")


@query("binned_rows", f"""WITH {FRAMES} SELECT session, count(*) AS frames, count(*) FILTER (WHERE k < 50) AS low_n, count(*) FILTER (WHERE k >= 50) AS high_n, round(max(speed) FILTER (WHERE k < 50), 4) AS low_top, round(max(speed) FILTER (WHERE k >= 50), 4) AS high_top FROM f GROUP BY session""")
def binned_rows(spark, sf_dir):
    f = frames(spark, sf_dir)
    bins = f.groupBy("session", F.when(F.col("k") < 50, "low").otherwise("high").alias("label")).agg(F.count("*").alias("n"), F.round(F.max("speed"), 4).alias("top"))
    return session_rows.with_bins(f.groupBy("session").agg(F.count("*").alias("frames")), bins, ["low", "high"], ["n", "top"]).fillna(0, ["low_n", "high_n"])


@query("sliced_frames", f"WITH {FRAMES}, n AS (SELECT session, frame, t_us, row_number() OVER (PARTITION BY session ORDER BY frame) - 1 AS i FROM f), s AS (SELECT * FROM n WHERE i >= 5 AND i < 40) SELECT session, frame, coalesce(t_us - lag(t_us) OVER (PARTITION BY session ORDER BY frame), 0) AS dt_us FROM s")
def sliced_frames(spark, sf_dir):
    return session_rows.sliced(frames(spark, sf_dir), 5, 40).select("session", "frame", "dt_us")


@query("unwrapped_clock", f"""WITH {FRAMES}, b AS (SELECT session, frame, t_us - CASE WHEN k > 80 THEN 50000000000 ELSE 0 END AS t FROM f), s AS (SELECT *, t - lag(t) OVER (PARTITION BY session ORDER BY frame) AS st FROM b),
m AS (SELECT session, coalesce(quantile_cont(st, 0.5) FILTER (WHERE st > 0), 0) AS med FROM s GROUP BY session)
SELECT s.session, frame, CASE WHEN st < 0 THEN med ELSE coalesce(st, 0) END::DOUBLE AS dt_us, round(t + sum(CASE WHEN st < 0 THEN med - st ELSE 0 END) OVER (PARTITION BY s.session ORDER BY frame ROWS UNBOUNDED PRECEDING), 1) AS t_adj FROM s JOIN m ON s.session = m.session""")
def unwrapped_clock(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("t_us", F.col("t_us") - F.when(F.col("k") > 80, 50_000_000_000).otherwise(0))
    return session_rows.unwrapped(f).select("session", "frame", "dt_us", F.round("t_adj", 1).alias("t_adj"))


@query("frame_lookups", f"WITH {FRAMES} SELECT session, frame, CASE WHEN k >= 30 THEN zone END AS stage, CASE WHEN k < 70 THEN k END AS mcu FROM f")
def frame_lookups(spark, sf_dir):
    f = frames(spark, sf_dir)
    tables = {"stage": f.where("k >= 30").select("session", "frame", F.col("zone").alias("stage")), "mcu": f.where("k < 70").select("session", "frame", F.col("k").alias("mcu"))}
    return session_rows.looked_up(f.select("session", "frame"), tables)


_PLACES = ("/data/p/d/video", "/data/p/d", "/data/p/d/mcu", "/data/p", "/data/p/old/animal", "/data/q")


@query("nearest_logs", "WITH c AS (SELECT c_custkey AS k FROM customer) SELECT 's' || k AS stem, CASE k % 6 WHEN 0 THEN '/data/p/d/video' WHEN 1 THEN '/data/p/d' WHEN 2 THEN '/data/p/d/mcu' WHEN 3 THEN '/data/p' WHEN 4 THEN '/data/p/old/animal' END || '/s' || k || '.tsv' AS found, CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 9 END AS tier FROM c")
def nearest_logs(spark, sf_dir):
    """Each recording's log lies beside it, above it, in a sibling folder, elsewhere in its project, or in another project."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("k") % 6 + 1).cast("int"))
    stem = F.concat(F.lit("s"), F.col("k"))
    files = c.select(F.concat(place, F.lit("/"), stem, F.lit(".tsv")).alias("path"))
    extra = c.where("k % 6 = 1").select(F.concat(F.lit("/data/p/"), stem, F.lit(".tsv")).alias("path"))
    wanted = c.select(F.lit("/data/p/d/video").alias("folder"), stem.alias("stem"), F.lit("/data/p/").alias("project"))
    return session_rows.nearest_file(wanted, files.unionByName(extra)).select("stem", "found", "tier")


@query("count_checks", f"WITH {FRAMES}, n AS (SELECT session, count(*) AS rows, count(*) + session % 4 - 1 AS frames FROM f GROUP BY session) SELECT session, rows, frames, frames - rows AS diff, round(abs(frames - rows)/frames*100, 4) AS percent FROM n WHERE frames > 0 AND frames <> rows")
def count_checks(spark, sf_dir):
    f = frames(spark, sf_dir)
    videos = f.groupBy("session").agg((F.count("*") + F.col("session") % 4 - 1).alias("frames"))
    return session_rows.count_check(f, videos)


@query("run_agreement", f"WITH {FRAMES} SELECT count(*) FILTER (WHERE k >= 20 AND k < 80) AS shared, round(count(*) FILTER (WHERE k >= 20 AND k < 80)/(count(*) FILTER (WHERE k >= 20 AND k < 80) + greatest(count(*) FILTER (WHERE k < 20), count(*) FILTER (WHERE k >= 80))), 6) AS overlap, true AS agrees FROM f")
def run_agreement(spark, sf_dir):
    f = frames(spark, sf_dir)
    p = joins.parity(f.where("k < 80"), f.where("k >= 20").withColumn("x", F.col("x") + 0.1), ["session", "frame"])
    return session_rows.agrees(p).select("shared", "overlap", "agrees")


@query("sent_coordinates", f"WITH {FRAMES} SELECT session, frame, CASE WHEN k < 10 THEN -1.0 ELSE k END::DOUBLE AS head_x, speed AS speed, CASE WHEN k < 50 THEN zone ELSE '' END AS place FROM f")
def sent_coordinates(spark, sf_dir):
    f = frames(spark, sf_dir)
    x, zone = F.when(F.col("k") >= 10, F.col("k").cast("double")), F.when(F.col("k") < 50, F.col("zone"))
    send = lambda n: live.coordinate(n, F.col("speed"), x, F.lit(None).cast("double"), zone)
    return f.select("session", "frame", send("Head_X").cast("double").alias("head_x"), send("speed").cast("double").alias("speed"), send("place").alias("place"))


@query("forecasts", f"WITH {FRAMES}, h AS (SELECT session, frame, speed, k, least(coalesce(CASE WHEN k < 20 THEN k * 5.0 END, CASE WHEN k > 30 THEN 2000.0/k WHEN k > 0 THEN 1000.0/k ELSE 33.0 END), 75.0) AS ms FROM f) SELECT session, frame, round(ms, 4) AS ms, round(CASE WHEN k % 7 <> 0 THEN speed + 40*ms/1000 END, 4) AS x FROM h")
def forecasts(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("ms", live.horizon_ms(F.col("k"), F.when(F.col("k") < 20, F.col("k") * 5.0)))
    return f.select("session", "frame", F.round("ms", 4).alias("ms"), F.round(live.ahead(F.col("x"), F.lit(40.0), F.col("ms"), F.col("k") % 7 == 0), 4).alias("x"))


@query("counts_since_reset", f"WITH {FRAMES}, r AS (SELECT session, frame, zone, sum(CASE WHEN k % 25 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT session, frame, zone, run::BIGINT AS run, count(*) OVER (PARTITION BY session, run, zone ORDER BY frame ROWS UNBOUNDED PRECEDING) AS n FROM r")
def counts_since_reset(spark, sf_dir):
    return live.since_reset(frames(spark, sf_dir), F.col("k") % 25 == 0).select("session", "frame", "zone", "run", "n")


@query("watchdogs", f"""WITH {FRAMES}, g AS (SELECT session, t_us, t_us - lag(t_us) OVER (PARTITION BY session ORDER BY frame) AS gap FROM f), s AS (SELECT session, count(*) FILTER (WHERE gap > 36000000000) AS stalls, max(gap) AS longest_us, (count(*) - 1)/((max(t_us) - min(t_us))/1e6) AS r FROM g GROUP BY session HAVING count(*) > 1)
SELECT session, stalls, longest_us, round(r * 1e6, 4) AS per_ms, r < 0.8*0.00003 AS low FROM s""")
def watchdogs(spark, sf_dir):
    d = live.watchdog(frames(spark, sf_dir), 36_000_000_000, 0.00003).where("per_second IS NOT NULL")
    return d.select("session", "stalls", "longest_us", F.round(F.col("per_second") * 1e6, 4).alias("per_ms"), "low")


@query("chunk_samples", """WITH RECURSIVE c AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS chunk, o_orderkey % 5 AS jitter FROM orders),
r AS (SELECT session, chunk, CASE WHEN abs(0 - (chunk*40 + jitter*0.3)/1000.0) < 0.001 THEN 0.0 ELSE (chunk*40 + jitter*0.3)/1000.0 END::DOUBLE AS s FROM c WHERE chunk = 1 UNION ALL
SELECT c.session, c.chunk, CASE WHEN abs(r.s + 0.04 - (c.chunk*40 + c.jitter*0.3)/1000.0) < 0.001 THEN r.s + 0.04 ELSE (c.chunk*40 + c.jitter*0.3)/1000.0 END FROM r JOIN c ON c.session = r.session AND c.chunk = r.chunk + 1)
SELECT session, chunk, i::INTEGER AS i, round(s + i/100.0, 6) AS t_s, (chunk*10 + i)::BIGINT AS value FROM r, unnest(range(4)) u(i)""")
def chunk_samples(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("chunk"), (F.col("o_orderkey") % 5).alias("jitter"))
    c = c.select("session", "chunk", (F.col("chunk") * 40 + F.col("jitter") * 0.3).alias("start_ms"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("chunk") * 10 + i).alias("values"))
    return live.chunk_times(c, 100.0).withColumn("t_s", F.round("t_s", 6))


_FOUND = " ".join(f"WHEN {_inside(ZONES[n])} THEN '{n}'" for n in ("box", "tri", "wide"))


@query("canonical_zones", f"WITH {FRAMES}, p AS (SELECT session, frame, speed AS x, k::DOUBLE AS y, CASE WHEN k % 3 = 0 THEN 'na' ELSE zone END AS logged FROM f) SELECT session, frame, coalesce(CASE {_FOUND} END, CASE WHEN logged <> 'na' THEN logged END) AS body_zone FROM p")
def canonical_zones(spark, sf_dir):
    f = frames(spark, sf_dir).select("session", "frame", "x", "y", F.when(F.col("k") % 3 == 0, "na").otherwise(F.col("zone")).alias("logged"))
    return session_rows.canonical_zone(zones.located(f, zone_table(spark)), "logged").select("session", "frame", "body_zone")


@query("distinct_paths", "SELECT '/data/' || o_custkey AS path, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey")
def distinct_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "/").when(F.col("o_orderkey") % 3 == 1, "").otherwise("//")
    return session_rows.distinct_paths(o.select(F.concat(F.lit("/data//"), F.col("o_custkey"), tail).alias("path"), F.col("o_orderkey").alias("ord")))


@query("report_order", "SELECT c_name AS \"File\", o_totalprice AS opened, row_number() OVER (ORDER BY c_name, o_totalprice, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 200")
def report_order(spark, sf_dir):
    """The first 200 rows of a report by file and start."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("File"), F.col("o_totalprice").alias("opened"), "o_orderkey")
    top = names.ordered(j, "File", "opened", "o_orderkey").limit(200)
    listed = top.agg(F.sort_array(F.collect_list(F.struct("File", "opened", "o_orderkey"))).alias("s"))
    return listed.select(F.posexplode("s").alias("at", "r")).select("r.File", "r.opened", (F.col("at") + 1).cast("long").alias("place"))


@query("change_log", f"WITH {FRAMES} SELECT session, frame, zone AS value FROM f WHERE k < 50 UNION ALL SELECT session, frame, 'again' FROM f WHERE k >= 90")
def change_log(spark, sf_dir):
    """Two writers add to one log."""
    f, path = frames(spark, sf_dir), scratch(spark, "changes")
    reports.append_changes(f.where("k < 50").select("session", "frame", F.col("zone").alias("value")), path)
    reports.append_changes(f.where("k >= 90").select("session", "frame", F.lit("again").alias("value")), path)
    return spark.read.schema("session long, frame long, value string").json(path)

