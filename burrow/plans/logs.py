"""Queries of counters, latencies, sequences and text counters over logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import scalars
from burrow.operators import events
from burrow.operators.events import Counter
from burrow.plans.registry import FRAMES, frames, query, table


def log(spark, sf_dir):
    """events as a log: prints ``<type> <k>`` of kind print for odd k, of kind event otherwise."""
    f = frames(spark, sf_dir)
    return f.select("session", "frame", "t_us", F.when(F.col("k") % 2 == 1, "print").otherwise("event").alias("kind"), F.concat_ws(" ", "zone", F.col("k").cast("string")).alias("name"), "zone", "k", "speed")


_LOGGED = f"{FRAMES}, l AS (SELECT session, frame, t_us, CASE WHEN k % 2 = 1 THEN 'print' ELSE 'event' END AS kind, concat_ws(' ', zone, k::VARCHAR) AS name, zone, k, speed FROM f)"


@query("counters_print", f"""WITH {_LOGGED} SELECT session, count(*) FILTER (WHERE kind = 'print' AND regexp_matches(name, '^click')) AS clicks, count(*) FILTER (WHERE name = 'view 7') AS sevens,
coalesce(sum(TRY_CAST(regexp_extract(name, 'view (\\d+)', 1) AS DOUBLE)) FILTER (WHERE regexp_matches(name, 'view (\\d+)')), 0) AS view_sum,
max_by(TRY_CAST(regexp_extract(name, 'error (\\d+)', 1) AS DOUBLE), frame) FILTER (WHERE regexp_matches(name, 'error (\\d+)'))::VARCHAR AS last_error FROM l GROUP BY session""")
def counters_print(spark, sf_dir):
    return events.counters(log(spark, sf_dir), [Counter("clicks", "print", regex="^click"), Counter("sevens", match="view 7"), Counter("view_sum", regex=r"view (\d+)", agg="sum"), Counter("last_error", regex=r"error (\d+)", agg="last")])


@query("latency_pairs", f"""WITH {_LOGGED}, m AS (SELECT session, frame, t_us, CASE WHEN zone = 'view' THEN 1 WHEN zone = 'click' THEN 2 END AS mark FROM l), b AS (SELECT *, lag(mark) OVER w AS was, lag(t_us) OVER w AS wt FROM m WHERE mark IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY frame))
SELECT session, frame, t_us - wt AS latency_us FROM b WHERE mark = 2 AND was = 1""")
def latency_pairs(spark, sf_dir):
    return events.latencies(log(spark, sf_dir), F.col("zone") == "view", F.col("zone") == "click")


@query("sequence_tokens", f"""WITH {_LOGGED} SELECT session, string_agg(CASE WHEN starts_with(name, 'click') THEN 'C' WHEN starts_with(name, 'error') THEN 'F' END, '' ORDER BY frame) AS seq FROM l WHERE starts_with(name, 'click') OR starts_with(name, 'error') GROUP BY session""")
def sequence_tokens(spark, sf_dir):
    return events.sequences(log(spark, sf_dir), {"C": "click", "F": "error"}).select("session", F.array_join("sequence", "").alias("seq"))


@query("sequence_columns", f"""WITH {_LOGGED}, q AS (SELECT session, list(CASE WHEN starts_with(name, 'click') THEN 'C' ELSE 'F' END ORDER BY frame) AS s FROM l WHERE starts_with(name, 'click') OR starts_with(name, 'error') GROUP BY session) SELECT session, s[1] AS T1, s[2] AS T2, s[3] AS T3 FROM q""")
def sequence_columns(spark, sf_dir):
    return events.fanned_out(events.sequences(log(spark, sf_dir), {"C": "click", "F": "error"}), "sequence", 3, "T")


@query("formula_accuracy", f"""WITH {_LOGGED}, c AS (SELECT session, count(*) FILTER (WHERE zone = 'click') AS ok, count(*) FILTER (WHERE zone = 'error') AS err, avg(k) FILTER (WHERE zone = 'view') AS vk, stddev_samp(k) FILTER (WHERE zone = 'view') AS vs FROM l GROUP BY session)
SELECT session, round(CASE WHEN ok + err > 0 THEN 100.0*ok/(ok+err) ELSE 0 END, 4) AS accuracy, round(coalesce(vk, 0), 4) AS mean_view, round(coalesce(vs, 0), 4) AS sd_view FROM c""")
def formula_accuracy(spark, sf_dir):
    c = events.counters(log(spark, sf_dir), [Counter("ok", regex="^click"), Counter("err", regex="^error"), Counter("views", regex=r"^view (\d+)", agg="append")])
    out = events.calculated(c, {"accuracy": "100 * ok / (ok + err)", "mean_view": "views + nothing", "sd_view": "stdev(views)"})
    return out.select("session", *(F.round(x, 4).alias(x) for x in ("accuracy", "mean_view", "sd_view")))


@query("session_minutes", f"WITH {FRAMES} SELECT session, round((max(t_us) - min(t_us))/60000000.0, 4) AS minutes FROM f GROUP BY session")
def session_minutes(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("session").agg(F.round((F.max("t_us") - F.min("t_us")) / 60_000_000.0, 4).alias("minutes"))


@query("substring_counters", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (WHERE contains(line, 'the')) AS the_lines, count(*) FILTER (WHERE contains(line, 'License')) AS license_lines FROM l GROUP BY doc_id""")
def substring_counters(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return events.substring_counts(lines, "doc_id", "line", {"the_lines": "the", "license_lines": "License"})


@query("changed_only", f"WITH {FRAMES}, z AS (SELECT session, frame, zone, lag(zone) OVER w AS b, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY session ORDER BY frame)) SELECT session, frame, zone FROM z WHERE n = 1 OR zone IS DISTINCT FROM b")
def changed_only(spark, sf_dir):
    return events.changed_only(frames(spark, sf_dir).select("session", "frame", "zone"), "zone")


@query("rolling_sd", f"WITH {FRAMES} SELECT session, frame, round(stddev_pop(speed) OVER (PARTITION BY session ORDER BY frame ROWS 19 PRECEDING), 3) AS sd FROM f")
def rolling_sd(spark, sf_dir):
    return events.rolling_sd(frames(spark, sf_dir), "speed", 20, "sd").select("session", "frame", F.round("sd", 3).alias("sd"))


@query("turn_counters", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS boxes, count(*) FILTER (WHERE contains(text, '?')) AS questions, max(length(text)) AS longest FROM conversations GROUP BY role")
def turn_counters(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("boxes"), F.count(F.when(F.contains("text", F.lit("?")), 1)).alias("questions"), F.max(F.length("text")).cast("long").alias("longest"))


@query("elapsed_format", f"""WITH {FRAMES} SELECT session, frame, printf('%02d:%02d.%03d', m // 60000, (m // 1000) % 60, m % 1000) AS elapsed FROM (SELECT session, frame, ((t_us - min(t_us) OVER (PARTITION BY session)) // 1000) AS m FROM f)""")
def elapsed_format(spark, sf_dir):
    from pyspark.sql import Window

    f = frames(spark, sf_dir).withColumn("m", F.floor((F.col("t_us") - F.min("t_us").over(Window.partitionBy("session"))) / 1000).cast("double"))
    return f.select("session", "frame", scalars.format_elapsed(F.col("m")).alias("elapsed"))


_SCORES = """p AS (SELECT session, lower(zone || ' ' || (k % (session % 9 + 1))) AS name FROM f),
t AS (SELECT session, (max(contains(name, 'click')::INT) + max(contains(name, '3')::INT) + max(contains(name, 'nothing')::INT))/3 AS taps, (max(contains(name, 'signup 7')::INT) + max(contains(name, 'view 8')::INT))/2 AS views FROM p GROUP BY session)"""


def _prints(spark, sf_dir):
    return frames(spark, sf_dir).select("session", F.concat(F.col("zone"), F.lit(" "), F.col("k") % (F.col("session") % 9 + 1)).alias("name"))


_TEMPLATES = {"taps": ["Click", "3", "nothing"], "views": ["signup 7", "View 8"]}


@query("template_scores", f"WITH {FRAMES}, {_SCORES} SELECT session, 'taps' AS template, round(taps, 6) AS score FROM t UNION ALL SELECT session, 'views', round(views, 6) FROM t")
def template_scores(spark, sf_dir):
    return events.template_scores(_prints(spark, sf_dir), _TEMPLATES).withColumn("score", F.round("score", 6))


@query("auto_configs", f"""WITH {FRAMES}, {_SCORES}, n AS (SELECT session, zone || ' ' || (k % (session % 9 + 1)) AS name, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY session) AS d, row_number() OVER (PARTITION BY session ORDER BY n DESC, name) AS place FROM n),
c AS (SELECT session, string_agg(name, '|' ORDER BY place) AS names FROM r WHERE d >= 5 AND place <= 10 GROUP BY session),
b AS (SELECT *, CASE WHEN taps >= views AND taps >= 0.5 THEN 'taps' WHEN views >= 0.5 THEN 'views' END AS template FROM t)
SELECT c.session, template, CASE WHEN template IS NULL THEN names END AS counters FROM c JOIN b USING (session)""")
def auto_configs(spark, sf_dir):
    return events.configured(_prints(spark, sf_dir), _TEMPLATES)
