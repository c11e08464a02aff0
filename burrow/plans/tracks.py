"""Queries of track measures, history and parsing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.functions import scalars
from burrow.operators import clean, pose, rollup, rules, series, tracks, zones
from burrow.plans.registry import FRAMES, frames, query, table

HOUR = 3_600_000_000


@query("trailing_mean", f"WITH {FRAMES} SELECT session, frame, round(avg(speed) OVER (PARTITION BY session ORDER BY frame ROWS 4 PRECEDING), 4) AS mean FROM f")
def trailing_mean(spark, sf_dir):
    return tracks.trailing_mean(frames(spark, sf_dir), "speed", "mean", 5).select("session", "frame", F.round("mean", 4).alias("mean"))


@query("trim_window", f"WITH {FRAMES}, s AS (SELECT *, t_us - min(t_us) OVER (PARTITION BY session) AS since FROM f) SELECT session, count(*) AS frames, min(frame) AS first, max(frame) AS last FROM s WHERE since >= {2 * HOUR} AND since <= {100 * HOUR} GROUP BY session")
def trim_window(spark, sf_dir):
    t = tracks.trimmed(frames(spark, sf_dir), 2 * HOUR, 100 * HOUR)
    return t.groupBy("session").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@query("trigger_history", f"""WITH {FRAMES} SELECT session, frame, count(*) OVER w AS recent_n, count(*) FILTER (WHERE speed > 20) OVER w AS recent_active FROM f
WINDOW w AS (PARTITION BY session ORDER BY t_us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW)""")
def trigger_history(spark, sf_dir):
    return tracks.recent(frames(spark, sf_dir), F.col("speed") > 20, 24 * HOUR).select("session", "frame", "recent_n", "recent_active")


@query("active_spans", f"""WITH {FRAMES}, o AS (SELECT session, frame, t_us, coalesce(speed > 20, false) AS act FROM f),
c AS (SELECT *, coalesce(lead(t_us) OVER w, t_us) AS nx, CASE WHEN row_number() OVER w = 1 OR act = lag(act) OVER w THEN 0 ELSE 1 END AS ch FROM o WINDOW w AS (PARTITION BY session ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT session, min(t_us) AS "start", max(nx) AS "end" FROM r WHERE act GROUP BY session, run""")
def active_spans(spark, sf_dir):
    return tracks.active_spans(frames(spark, sf_dir), F.col("speed") > 20)


@query("line_history_trials", f"""WITH {FRAMES}, h AS (SELECT session, frame, k, speed, coalesce(max(k) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM f) SELECT session, frame, k, round(speed, 4) AS value FROM h WHERE k > best""")
def line_history_trials(spark, sf_dir):
    return tracks.history_points(frames(spark, sf_dir), "speed", "k").select("session", "frame", "k", F.round("speed", 4).alias("value"))


@query("line_history_changes", f"WITH {FRAMES}, h AS (SELECT session, frame, k // 20 AS level, lag(k // 20) OVER w AS was, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY session ORDER BY frame)) SELECT session, frame, level FROM h WHERE i = 1 OR level IS DISTINCT FROM was")
def line_history_changes(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("level", F.floor(F.col("k") / 20))
    return tracks.history_points(f, "level").select("session", "frame", "level")


@query("carried_subset", f"""WITH {FRAMES} SELECT session, zone, frame, (sum(dt_us) OVER (PARTITION BY session, zone ORDER BY frame ROWS UNBOUNDED PRECEDING) - first_value(dt_us) OVER (PARTITION BY session, zone ORDER BY frame))::BIGINT AS state_us FROM d""")
def carried_subset(spark, sf_dir):
    return tracks.state_clock(series.intervals(frames(spark, sf_dir)), "zone").select("session", "zone", "frame", "state_us")


@query("downsampled_track", f"""WITH {FRAMES}, n AS (SELECT session, frame, speed, row_number() OVER (PARTITION BY session ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM f),
t AS (SELECT *, (n - 1)/19.0::DOUBLE AS step FROM n) SELECT session, frame, round(speed, 4) AS speed FROM t WHERE n <= 20 OR ceil(i/step)*step < i + 1""")
def downsampled_track(spark, sf_dir):
    return tracks.evenly_spaced(frames(spark, sf_dir), 20).select("session", "frame", F.round("speed", 4).alias("speed"))


@query("session_clock", f"""WITH {FRAMES}, c AS (SELECT session, frame, CASE WHEN session % 3 = 0 THEN NULL WHEN k < 30 THEN NULL ELSE k END::DOUBLE AS mcu, CASE WHEN session % 2 = 0 THEN NULL ELSE speed END AS cam FROM f),
h AS (SELECT *, count(mcu) OVER s > 0 AS hm, count(cam) OVER s > 0 AS hc FROM c WINDOW s AS (PARTITION BY session)),
p AS (SELECT *, CASE WHEN hm THEN mcu WHEN hc THEN cam ELSE frame/30.0*1000 END AS raw, CASE WHEN hm THEN 'mcu' WHEN hc THEN 'cam' ELSE 'index' END AS clock_source FROM h)
SELECT session, frame, clock_source, round(coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING), 0), 3) AS clock_ms FROM p""")
def session_clock(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"mcu": F.when((F.col("session") % 3 != 0) & (F.col("k") >= 30), F.col("k").cast("double")), "cam": F.when(F.col("session") % 2 != 0, F.col("speed"))})
    return tracks.session_clock(f, ["mcu", "cam"]).select("session", "frame", "clock_source", F.round("clock_ms", 3).alias("clock_ms"))


@query("frame_fit", f"WITH {FRAMES}, o AS (SELECT session, avg((speed < -1 OR speed > 101 OR k < -1 OR k > 61)::INT::DOUBLE) AS outside FROM f WHERE speed IS NOT NULL AND k IS NOT NULL GROUP BY session) SELECT session, round(outside, 6) AS outside, outside <= 0.3 AS fits FROM o")
def frame_fit(spark, sf_dir):
    return tracks.fits_frame(frames(spark, sf_dir), 100.0, 60.0, 0.3).withColumn("outside", F.round("outside", 6))


@query("latency_budget", """WITH r AS (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events WHERE value IS NOT NULL AND value >= 0 AND value <= 10000),
p AS (SELECT stage, quantile_cont(value, 0.95) AS p95 FROM r WHERE rn <= 240 GROUP BY stage), t AS (SELECT coalesce(sum(p95), 0) AS total FROM p)
SELECT round(total, 4) AS total_ms, round(greatest(0, least(75, CASE WHEN total > 0 THEN total ELSE 33 END)), 4) AS horizon_ms FROM t""")
def latency_budget(spark, sf_dir):
    r = rollup.latency_summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), "stage", "value", "event_id")
    return tracks.stage_budget(r).select(F.round("total_ms", 4).alias("total_ms"), F.round("horizon_ms", 4).alias("horizon_ms"))


@query("tracker_quality", f"""WITH {FRAMES}, p AS (SELECT session, frame, CASE WHEN k % 7 <> 0 THEN speed END AS x, k::DOUBLE AS y, speed * 10 AS area FROM f),
b AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS hit, row_number() OVER w AS back FROM p WINDOW w AS (PARTITION BY session ORDER BY frame DESC)),
c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY session ORDER BY frame DESC ROWS UNBOUNDED PRECEDING) AS fb FROM b),
g AS (SELECT session, count(*) FILTER (WHERE back <= 120) AS frames, avg(hit::INT::DOUBLE) FILTER (WHERE back <= 120) AS sr, sqrt(var_pop(x) FILTER (WHERE hit AND fb <= 30) + var_pop(y) FILTER (WHERE hit AND fb <= 30)) AS j, list_sort(list(area) FILTER (WHERE hit AND fb <= 120)) AS a FROM c WHERE back <= 120 OR fb <= 120 GROUP BY session)
SELECT session, frames, round(sr, 6) AS success_rate, round(coalesce(j, 0), 4) AS jitter, round(coalesce(a[1 + len(a)//2], 0), 4) AS area_median, round(coalesce(a[1 + greatest(0, floor(len(a)*0.1::DOUBLE)::INT - 1)], 0), 4) AS area_p10, round(coalesce(a[1 + least(len(a) - 1, floor(len(a)*0.9::DOUBLE)::INT)], 0), 4) AS area_p90 FROM g""")
def tracker_quality(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"x": F.when(F.col("k") % 7 != 0, F.col("speed")), "area": F.col("speed") * 10})
    q = tracks.tracker_quality(f)
    return q.select("session", "frames", F.round("success_rate", 6).alias("success_rate"), *(F.round(c, 4).alias(c) for c in ("jitter", "area_median", "area_p10", "area_p90")))


@query("swap_anchor", f"""WITH {FRAMES}, p AS (SELECT session, speed AS hx, k::DOUBLE AS hy, speed + 3 AS bx, k::DOUBLE AS by_, 40.0::DOUBLE AS ax, 50.0::DOUBLE AS ay, speed + 9 AS cx, k + 1.0::DOUBLE AS cy FROM f),
e AS (SELECT session, 0 AS place, 'a' AS anchor, sqrt(pow(hx-ax,2)+pow(hy-ay,2)) AS dh, sqrt(pow(bx-ax,2)+pow(by_-ay,2)) AS db FROM p UNION ALL SELECT session, 1, 'c', sqrt(pow(hx-cx,2)+pow(hy-cy,2)), sqrt(pow(bx-cx,2)+pow(by_-cy,2)) FROM p),
m AS (SELECT session, place, anchor, quantile_cont(dh, 0.5) AS mh, quantile_cont(db, 0.5) AS mb FROM e GROUP BY ALL HAVING count(*) >= 20),
r AS (SELECT *, greatest(mh, mb)/least(mh, mb) AS ratio, row_number() OVER (PARTITION BY session ORDER BY greatest(mh, mb)/least(mh, mb) DESC, place) AS i FROM m WHERE least(mh, mb) > 0)
SELECT session, anchor, mh > mb AS head_is_farther, round(ratio, 4) AS ratio FROM r WHERE i = 1 AND ratio >= 1.25""")
def swap_anchor(spark, sf_dir):
    f = frames(spark, sf_dir)
    at = {"h": ("x", "y"), "b": (F.col("x") + 3, "y"), "a": (F.lit(40.0), F.lit(50.0)), "c": (F.col("x") + 9, F.col("y") + 1)}
    col = lambda c: F.col(c) if isinstance(c, str) else c
    w = f.select("session", *(col(c).alias(f"{p}_{n}") for p, xy in at.items() for n, c in zip("xy", xy)))
    return tracks.swap_anchor(w, "h", "b", ["a", "c"]).withColumn("ratio", F.round("ratio", 4))


@query("zone_nesting", """WITH z AS (SELECT n_name AS name, n_regionkey AS r, n_nationkey AS k FROM nation), p AS (SELECT name, lead(name) OVER (PARTITION BY r ORDER BY k) AS parent, count(*) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)::INT AS depth FROM z)
SELECT *, row_number() OVER (ORDER BY depth DESC, name)::INT AS ord FROM p""")
def zone_nesting(spark, sf_dir):
    """Each nation is a square about its region's middle, the larger the later its key, so a region's nations lie in one another."""
    half, middle = F.col("n_nationkey") * 3.0 + 2, F.col("n_regionkey") * 1000.0
    corner = lambda x, y: F.struct((middle + x * half).alias("x"), (y * half).alias("y"))
    z = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("ord"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("points"))
    return tracks.nested_zones(zones.sized(z)).select("name", "parent", "depth", "ord")


@query("frame_scales", f"""WITH {FRAMES}, p AS (SELECT session, speed*1.3 AS x, k*1.3 AS y, CASE WHEN speed < 245 THEN 'near' WHEN speed < 400 THEN 'far' ELSE '-' END AS zone FROM d WHERE session % 3 <> 0 OR k < 20),
s AS (SELECT session, count(*) AS n, greatest(1, max(x)/490, max(y)/100) AS lo, max(x) <= 490 + 490*0.02 AND max(y) <= 100 + 100*0.02 AS fits FROM p GROUP BY session),
t AS (SELECT p.session, round(lo + i*0.01, 2) AS k, p.x, p.y, zone FROM p JOIN s USING (session), range(0, 201) q(i) WHERE n >= 20 AND NOT fits AND zone <> '-'),
h AS (SELECT session, k, avg(CASE zone WHEN 'near' THEN x/(490*k) < 0.5 AND x >= 0 AND y/(100*k) < 1 AND y >= 0 ELSE x/(490*k) >= 0.5 AND x/(490*k) < 0.8163 AND y/(100*k) < 1 AND y >= 0 END::INT) AS share, count(*) AS scored FROM t GROUP BY ALL),
b AS (SELECT session, arg_max(k, struct_pack(a := share, b := -k)) AS k, max(share) AS share FROM h WHERE scored >= 20 GROUP BY session)
SELECT session, CASE WHEN n < 20 THEN NULL WHEN fits THEN 1.0 WHEN share >= 0.8 THEN k END AS scale FROM s LEFT JOIN b USING (session)""")
def frame_scales(spark, sf_dir):
    """Points recorded in a frame 1.3 times the declared one, with the zones that they were seen in."""
    f = frames(spark, sf_dir).where("session % 3 <> 0 OR k < 20")
    p = f.select("session", "frame", (F.col("speed") * 1.3).alias("x"), (F.col("k") * 1.3).alias("y"), F.when(F.col("speed") < 245, "near").when(F.col("speed") < 400, "far").otherwise("-").alias("zone"))
    box = lambda a, b: [(a, 0.0), (b, 0.0), (b, 1.0), (a, 1.0)]
    z = spark.createDataFrame([("near", box(0.0, 0.5)), ("far", box(0.5, 0.8163))], "name string, points array<struct<x:double,y:double>>")
    return tracks.frame_scale(p, z, 490.0, 100.0).select("session", "scale")


@query("content_hashes", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN substr(sha1(text), 1, 12) END AS short_hash, sha256(text) AS long_hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("short_hash"), F.sha2(F.col("text").cast("binary"), 256).alias("long_hash"))


@query("parsed_cells", f"""WITH {FRAMES}, c AS (SELECT session, frame, CASE k % 6 WHEN 0 THEN 'na' WHEN 1 THEN '' WHEN 2 THEN ' N/A ' WHEN 3 THEN k::VARCHAR || '.5' WHEN 4 THEN 'x' || k ELSE k::VARCHAR END AS cell,
printf('%02d:%02d.%03d', k, k % 60, k * 7) AS clock FROM f) SELECT session, frame, TRY_CAST(trim(cell) AS DOUBLE) AS number, round((split_part(clock, ':', 1)::DOUBLE * 60 + split_part(clock, ':', 2)::DOUBLE)*1000, 3) AS ms FROM c""")
def parsed_cells(spark, sf_dir):
    k = F.col("k")
    cell = F.when(k % 6 == 0, "na").when(k % 6 == 1, "").when(k % 6 == 2, " N/A ").when(k % 6 == 3, F.concat(k.cast("string"), F.lit(".5"))).when(k % 6 == 4, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    clock = F.format_string("%02d:%02d.%03d", k, k % 60, k * 7)
    return frames(spark, sf_dir).select("session", "frame", scalars.number(cell).alias("number"), scalars.elapsed_ms(clock).alias("ms"))


@query("state_cells", f"""WITH {FRAMES}, c AS (SELECT session, frame, CASE k % 4 WHEN 0 THEN '-' WHEN 1 THEN 'State:' || zone WHEN 2 THEN 'a|' || zone ELSE zone END AS cell FROM f)
SELECT session, frame, CASE WHEN cell = '-' THEN '' ELSE regexp_replace(split_part(cell, '|', -1), '^State:', '') END AS state FROM c""")
def state_cells(spark, sf_dir):
    k, z = F.col("k"), F.col("zone")
    cell = F.when(k % 4 == 0, "-").when(k % 4 == 1, F.concat(F.lit("State:"), z)).when(k % 4 == 2, F.concat(F.lit("a|"), z)).otherwise(z)
    return frames(spark, sf_dir).select("session", "frame", scalars.last_state(cell).alias("state"))


@query("folder_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 3 = 0 THEN (o_orderdate + CASE WHEN year(o_orderdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END)::DATE END AS day FROM orders")
def folder_dates(spark, sf_dir):
    # two digits of the year mean this century
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    folder = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 3 == 0, F.date_format("o_orderdate", "ddMMyy")).otherwise("notes")
    return o.select("o_orderkey", scalars.folder_date(folder).alias("day"))


@query("speed_ceiling", f"WITH {FRAMES} SELECT session, round(quantile_cont(CASE WHEN speed > 0 THEN speed END, 0.95), 4) AS colour_max, count(*) FILTER (WHERE speed > 0) AS moving FROM f GROUP BY session")
def speed_ceiling(spark, sf_dir):
    moving = F.when(F.col("speed") > 0, F.col("speed"))
    return frames(spark, sf_dir).groupBy("session").agg(F.round(F.percentile(moving, 0.95), 4).alias("colour_max"), F.count(moving).alias("moving"))


@query("ema_value", f"""WITH RECURSIVE {FRAMES}, n AS (SELECT session, frame, speed, row_number() OVER (PARTITION BY session ORDER BY frame) AS i FROM f),
r AS (SELECT session, frame, i, speed*(1 - exp(-0.2)) AS ema FROM n WHERE i = 1 UNION ALL SELECT n.session, n.frame, n.i, n.speed*(1 - exp(-0.2)) + exp(-0.2)*r.ema FROM r JOIN n ON n.session = r.session AND n.i = r.i + 1)
SELECT session, frame, round(ema, 6) AS ema FROM r""")
def ema_value(spark, sf_dir):
    return clean.ema(frames(spark, sf_dir), "speed", "ema", 5.0).select("session", "frame", F.round("ema", 6).alias("ema"))


@query("feature_frames", f"""WITH RECURSIVE {FRAMES}, g AS (SELECT *, degrees(atan2(k % 5, 4.0)) AS heading, sqrt(16 + pow(k % 5, 2)) AS axis, CASE WHEN dt_us > 0 THEN step*1e6/dt_us ELSE 0 END AS v, row_number() OVER (PARTITION BY session ORDER BY frame) AS i FROM d),
r AS (SELECT session, i, v AS level FROM g WHERE i = 1 UNION ALL SELECT g.session, g.i, r.level + 0.4*(g.v - r.level) FROM r JOIN g ON g.session = r.session AND g.i = r.i + 1),
h AS (SELECT *, heading - lag(heading) OVER (PARTITION BY session ORDER BY frame) AS dd, quantile_cont(axis, 0.5) OVER (PARTITION BY session ORDER BY frame ROWS 199 PRECEDING) AS body FROM g)
SELECT session, frame, round(level, 6) AS speed_ema, round(heading, 6) AS heading, round(CASE WHEN dt_us > 0 THEN (dd - 360*ceil((dd - 180)/360))*1e6/dt_us END, 6) AS turning, round(body, 6) AS body, round(axis/body, 6) AS elongation FROM h JOIN r USING (session, i)""")
def feature_frames(spark, sf_dir):
    f = series.intervals(frames(spark, sf_dir)).withColumns({"hx": F.col("x"), "hy": F.col("y"), "tx": F.col("x") - 4, "ty": F.col("y") - F.col("k") % 5})
    return rules.features(f).select("session", "frame", *(F.round(c, 6).alias(c) for c in ("speed_ema", "heading", "turning", "body", "elongation")))


@query("swap_share", f"""WITH {FRAMES}, e AS (SELECT session, CASE WHEN k % 5 = 0 THEN 0 ELSE k - 60 END AS ev FROM f), j AS (SELECT session, count(*) FILTER (WHERE ev <> 0) AS judged, count(*) FILTER (WHERE ev < 0) AS neg FROM e GROUP BY session)
SELECT session, judged, CASE WHEN judged >= 10 THEN round(neg/judged, 6) END AS swapped, CASE WHEN judged >= 10 AND neg/judged >= 0.4 THEN 'anatomical' ELSE 'shape' END AS method FROM j""")
def swap_share(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("evidence", F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("k") - 60))
    s = pose.swap_fraction(f)
    return s.select("session", "judged", F.round("swapped", 6).alias("swapped"), pose.swap_method(F.col("swapped")).alias("method"))


@query("refined_track", f"""WITH {FRAMES}, p AS (SELECT session, frame, t_us, speed AS x0, k::DOUBLE AS y0, (k % 10)/10.0 AS conf FROM d),
l AS (SELECT session, least(greatest(quantile_cont(conf, 0.05), 0.1), 0.6) AS lim FROM p GROUP BY session), g AS (SELECT session, frame, t_us, CASE WHEN conf >= lim THEN x0 END AS x, CASE WHEN conf >= lim THEN y0 END AS y FROM p JOIN l USING (session)),
j AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS jump FROM g WINDOW w AS (PARTITION BY session ORDER BY frame)),
q AS (SELECT session, quantile_cont(jump, 0.25) AS q1, quantile_cont(jump, 0.5) AS q2, quantile_cont(jump, 0.75) AS q3, count(jump) AS n FROM j GROUP BY session),
m AS (SELECT j.session, quantile_cont(abs(jump - q2), 0.5) AS mad FROM j JOIN q USING (session) GROUP BY j.session),
u AS (SELECT session, n, q2 + 6*CASE WHEN q3 - q1 > 0 THEN q3 - q1 WHEN mad > 0 THEN 1.4826*mad ELSE greatest(0.25*q2, 1) END AS far FROM q JOIN m USING (session)),
o AS (SELECT j.session, frame, t_us, CASE WHEN NOT coalesce(n >= 8 AND jump > far, false) THEN x END AS x, CASE WHEN NOT coalesce(n >= 8 AND jump > far, false) THEN y END AS y FROM j JOIN u USING (session)),
s AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t_us END IGNORE NULLS) OVER a AS ta, last_value(x IGNORE NULLS) OVER a AS xa, last_value(y IGNORE NULLS) OVER a AS ya,
  first_value(CASE WHEN x IS NOT NULL THEN t_us END IGNORE NULLS) OVER z AS tb, first_value(x IGNORE NULLS) OVER z AS xb, first_value(y IGNORE NULLS) OVER z AS yb FROM o
  WINDOW a AS (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z AS (PARTITION BY session ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT session, frame, round(coalesce(x, CASE WHEN tb - ta <= {10 * HOUR} THEN xa + (xb - xa)*(t_us - ta)/(tb - ta) END), 4) AS x, round(coalesce(y, CASE WHEN tb - ta <= {10 * HOUR} THEN ya + (yb - ya)*(t_us - ta)/(tb - ta) END), 4) AS y FROM s""")
def refined_track(spark, sf_dir):
    f = series.intervals(frames(spark, sf_dir)).withColumn("conf", (F.col("k") % 10) / 10.0)
    return clean.refined(f, most_gap_us=10 * HOUR).select("session", "frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
