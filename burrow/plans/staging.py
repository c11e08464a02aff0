"""Queries of templates over logs and of stages that must run again."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import templates
from burrow.plans.registry import FRAMES, frames, query
from burrow.sources import stages

TEMPLATES = [
    templates.Template.of(
        {
            "id": "sales",
            "name": "Sales",
            "parameters": [{"name": "goal", "type": "INT", "default": 3, "min": 1}],
            "counters": {"clicks": {"type": "print", "match": "click"}, "buys": {"type": "print", "match": "purchase"}, "none": {"type": "print", "match": ""}},
            "calculations": {"rate": "buys / clicks", "met": "1 if buys >= goal else 0", "score": "round(100 * rate, 1) + max(met, 0.5) - none"},
            "columns": [{"key": "subject_id", "label": "Subject"}, {"key": "buys", "label": "Bought"}, {"key": "rate", "label": "Rate", "format": "{:.1%}"}, {"key": "score", "label": "Score", "format": "{:.2f} points"}, {"key": "lost"}],
        }
    ),
    templates.Template.of(
        {
            "id": "views",
            "name": "Views",
            "counters": {"views": {"match": "view"}, "clicks": {"match": "click"}},
            "calculations": {"per": "(views - clicks) // (views % 3)", "root": "sqrt(views - clicks)", "odd": "missing + 1"},
            "columns": [{"key": "box_id", "label": "Box"}, {"key": "views", "format": "{:d}"}, {"key": "per", "format": "{:.0f}"}, {"key": "root", "format": "{:.3f}"}, {"key": "odd", "label": "Odd", "format": "{:.1f}"}, {"key": "session", "label": "Session"}],
        }
    ),
]

_CELL = "SELECT file, '{}' AS template, '{}' AS label, {} AS value FROM c"


@query("template_cells", f"""WITH {FRAMES}, l AS (SELECT 'logs/m' || session || CASE WHEN session % 5 = 0 THEN '' ELSE '-Box' || session % 7 || '-2024-03-0' || (session % 9 + 1) || '-101500.tsv' END AS file, session, frame || chr(9) || zone AS line FROM d),
c AS (SELECT file, any_value(session) AS s, count(*) FILTER (WHERE contains(line, 'click')) AS k, count(*) FILTER (WHERE contains(line, 'purchase')) AS b, count(*) FILTER (WHERE contains(line, 'view')) AS v FROM l GROUP BY file)
{' UNION ALL '.join(_CELL.format(t, n, v) for t, n, v in (
    ("sales", "Subject", "CASE WHEN s % 5 = 0 THEN '' ELSE 'm' || s END"), ("sales", "Bought", "b::VARCHAR"), ("sales", "Rate", "printf('%.1f', CASE WHEN k = 0 THEN 0.0 ELSE 100.0*(b/k) END) || '%'"),
    ("sales", "Score", "printf('%.2f', round_even(100*CASE WHEN k = 0 THEN 0 ELSE b/k END, 1) + CASE WHEN b >= 3 THEN 1 ELSE 0.5 END) || ' points'"),
    ("views", "Box", "CASE WHEN s % 5 = 0 THEN '' ELSE (s % 7)::VARCHAR END"), ("views", "views", "v::VARCHAR"), ("views", "per", "printf('%.0f', CASE WHEN v % 3 = 0 THEN 0.0 ELSE floor((v - k)/(v % 3)) END)"),
    ("views", "root", "CASE WHEN v >= k THEN printf('%.3f', sqrt(v - k)) ELSE '' END"), ("views", "Odd", "''"), ("views", "Session", "CASE WHEN s % 5 = 0 THEN 'm' || s ELSE 'm' || s || '-2024-03-0' || (s % 9 + 1) END")))}""")
def template_cells(spark, sf_dir):
    """Two templates over one log of lines, in one scan."""
    s = F.col("session")
    named = F.concat(F.lit("-Box"), (s % 7).cast("string"), F.lit("-2024-03-0"), (s % 9 + 1).cast("string"), F.lit("-101500.tsv"))
    file = F.concat(F.lit("logs/m"), s.cast("string"), F.when(s % 5 == 0, "").otherwise(named))
    lines = frames(spark, sf_dir).select(file.alias("file"), F.concat_ws("\t", "frame", "zone").alias("line"))
    return templates.cells(lines, TEMPLATES)


#: A graph with two ways to its end.
STAGES = [
    stages.Stage("measure", parameters=("unit",), after=("correct", "space")),
    stages.Stage("ingest", inputs=("digest",)),
    stages.Stage("track", parameters=("model",), after=("ingest",)),
    stages.Stage("correct", parameters=("gate",), after=("track",)),
    stages.Stage("space", inputs=("zones",)),
]


def _sessions(spark, sf_dir, later: bool):
    """Sessions with digests and parameters, before and after some of them changed."""
    f = frames(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"), F.max("frame").alias("last"))
    s = F.col("session")
    new = lambda rest, a, b: F.when((s % 7 == rest) & F.lit(later), b).otherwise(a)
    return f.select("session", F.concat_ws("/", "n", F.when((s % 7 == 1) & F.lit(later), F.col("last") + 1).otherwise(F.col("last"))).alias("digest"), new(2, "m1", "m2").alias("model"), new(3, "0.5", "0.6").alias("gate"), new(4, "square", "round").alias("zones"), F.when(s % 11 == 0, F.lit(None)).otherwise(new(5, "px", "cm")).alias("unit"))


def _key(later: bool) -> str:
    told = lambda c: f"coalesce('=' || length({c}) || ':' || {c}, '-')"
    new = lambda rest, a, b: f"CASE WHEN session % 7 = {rest} AND {later} THEN '{b}' ELSE '{a}' END"
    sha = lambda *p: f"sha256({' || chr(124) || '.join(p)})[1:16]"
    return f"""(SELECT session, ing, tra, cor, spa, {sha("'measure'", told("unit"), "cor", "spa")} AS mea FROM (SELECT *, {sha("'correct'", told("gate"), "tra")} AS cor FROM (SELECT *, {sha("'track'", told("model"), "ing")} AS tra FROM
(SELECT *, {sha("'ingest'", told("digest"))} AS ing, {sha("'space'", told("zones"))} AS spa FROM (SELECT session, count(*) || '/' || (max(frame) + CASE WHEN session % 7 = 1 AND {later} THEN 1 ELSE 0 END) AS digest, {new(2, "m1", "m2")} AS model, {new(3, "0.5", "0.6")} AS gate, {new(4, "square", "round")} AS zones, CASE WHEN session % 11 <> 0 THEN {new(5, "px", "cm")} END AS unit FROM d GROUP BY session)))))"""


_LONG = "UNPIVOT {} ON ing AS ingest, tra AS track, cor AS correct, spa AS space, mea AS measure INTO NAME stage VALUE key"


@query("stale_stages", f"""WITH {FRAMES}, o AS {_key(False)}, n AS {_key(True)}, ol AS ({_LONG.format("o")}), nl AS ({_LONG.format("n")})
SELECT session, stage, key FROM nl ANTI JOIN ol USING (session, stage, key)""")
def stale_stages(spark, sf_dir):
    """What a changed input, parameter or zone makes stale: each with all that comes after it, and nothing else."""
    done = stages.keys(_sessions(spark, sf_dir, False), STAGES)
    return stages.stale(stages.keys(_sessions(spark, sf_dir, True), STAGES), done)


@query("staged_results", f"""WITH {FRAMES}, a AS (SELECT session, count(*) AS n, session % 7 AS r FROM d GROUP BY session)
SELECT session, CASE WHEN r IN (1, 2, 3, 4, 5) AND NOT (r = 5 AND session % 11 = 0) THEN 2 ELSE 1 END AS run, n * 10 + CASE WHEN r IN (2) THEN 2 ELSE 1 END AS tracked, n AS ingested FROM a""")
def staged_results(spark, sf_dir):
    """All stages run, then again with what changed: each session's result is of the run that it was last stale in."""
    n = frames(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"))
    steps = {
        "ingest": lambda s, _: s.select("session").join(n, "session").select("session", F.col("n").alias("ingested")),
        "track": lambda s, b: s.select("session", "model").join(b["ingest"], "session").select("session", (F.col("ingested") * 10 + F.when(F.col("model") == "m2", 2).otherwise(1)).alias("tracked")),
        "correct": lambda s, b: b["track"],
        "space": lambda s, _: s.select("session", "zones"),
        "measure": lambda s, b: b["correct"].join(b["space"], "session").select("session", "tracked"),
    }
    stamps, _ = stages.run_stale(spark, _sessions(spark, sf_dir, False), STAGES, steps)
    stamps, _ = stages.run_stale(spark, _sessions(spark, sf_dir, True), STAGES, steps, stamps)
    runs = stages.latest(stamps.where("stage = 'measure'")).select("session", F.col("run").cast("int").alias("run"))
    return stages.results(spark, stamps, "measure").join(runs, "session").join(stages.results(spark, stamps, "ingest"), "session").select("session", "run", "tracked", "ingested")
