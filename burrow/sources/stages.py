"""Which stages of which sessions must run again, and running just these.

A stage's key is the digest of its name, its own parameters, the inputs it reads and the keys of the stages before it. So a changed input or
parameter changes the keys of exactly the stages that it reaches, in a graph of any shape. What was done is a table of stamps (session, stage, key, artifact);
results are Parquet tables, a new one for each run, and a session's result is in the one that its latest stamp names.

Defined results: a session without a stamp is stale; a null digest or parameter is a value like any other; sessions that
disappear from the inputs keep their stamps and aren't run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.scratch import scratch, written


@dataclass(frozen=True)
class Stage:
    """inputs and parameters: columns of the session table that this stage itself reads; after: the stages whose results it reads."""

    name: str
    inputs: tuple[str, ...] = ()
    parameters: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


def ordered(stages: list[Stage]) -> list[Stage]:
    """Stages with those they need before them; a circle or an unknown stage is an error."""
    out: list[Stage] = []
    left = list(stages)
    while left:
        ready = [s for s in left if all(any(d.name == a for d in out) for a in s.after)]
        if not ready:
            raise ValueError(f"these stages wait for one another or for unknown ones: {', '.join(s.name for s in left)}")
        out += ready
        left = [s for s in left if s not in ready]
    return out


def _told(c: str) -> Column:
    """A value with its kind of absence, so that neighbours can't be taken for one another."""
    return F.coalesce(F.concat(F.lit("="), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))


def keys(sessions: DataFrame, stages: list[Stage]) -> DataFrame:
    """session, stage, key: 16 hexadecimal digits."""
    d, names = sessions, {}
    for i, s in enumerate(ordered(stages)):
        names[s.name] = f"key_{i}"
        text = F.concat_ws("|", F.lit(s.name), *map(_told, (*s.inputs, *s.parameters)), *(F.col(names[a]) for a in s.after))
        d = d.withColumn(names[s.name], F.substring(F.sha2(text, 256), 1, 16))
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), F.col(k).alias("key")) for n, k in names.items()))
    return d.select("session", F.explode(rows).alias("k")).select("session", "k.*")


def stale(wanted: DataFrame, stamps: DataFrame) -> DataFrame:
    """session, stage, key of what must run: whose key no stamp has."""
    done = stamps.select("session", "stage", "key").distinct()
    return wanted.join(done, ["session", "stage", "key"], "left_anti")


def latest(stamps: DataFrame) -> DataFrame:
    """session, stage, key, artifact, run of each session's last run of a stage."""
    return stamps.groupBy("session", "stage").agg(F.max_by(F.struct("key", "artifact", "run"), "run").alias("s")).select("session", "stage", "s.*")


Step = Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]


def run_stale(spark: SparkSession, sessions: DataFrame, stages: list[Stage], steps: Mapping[str, Step], stamps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs each stage for its stale sessions; gives stamps, old and new, and what ran (session, stage).

    A step gets the sessions to run (rows of the session table) and the present results of the stages before it, of these sessions, and returns
    rows with a column session.
    """
    empty = spark.createDataFrame([], "session long, stage string, key string, artifact string, run long")
    stamps = empty if stamps is None else stamps
    wanted = written(keys(sessions, stages), "stage-keys")
    run = (stamps.agg(F.max("run")).first()[0] or 0) + 1
    ran = empty.select("session", "stage")
    for s in ordered(stages):
        due = stale(wanted.where(F.col("stage") == s.name), stamps)
        now = written(due.select("session", "key"), "stage-due")
        if now.isEmpty():
            continue
        before = {a: results(spark, stamps, a).join(now.select("session"), "session", "left_semi") for a in s.after}
        path = scratch(spark, f"stage-{s.name}")
        steps[s.name](sessions.join(now.select("session"), "session", "left_semi"), before).write.parquet(path)
        stamps = written(stamps.unionByName(now.select("session", F.lit(s.name).alias("stage"), "key", F.lit(path).alias("artifact"), F.lit(run).cast("long").alias("run"))), "stamps", keep=True)
        ran = ran.unionByName(now.select("session", F.lit(s.name).alias("stage")))
    return stamps, ran


def results(spark: SparkSession, stamps: DataFrame, stage: str) -> DataFrame:
    """The present results of a stage: of each session, the rows of the artifact of its last run."""
    last = latest(stamps.where(F.col("stage") == stage)).select("session", "artifact")
    out = None
    for r in last.select("artifact").distinct().orderBy("artifact").collect():  # one path a run
        rows = spark.read.parquet(r["artifact"]).join(last.where(F.col("artifact") == r["artifact"]).select("session"), "session", "left_semi")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"the stage {stage} hasn't run")
    return out
