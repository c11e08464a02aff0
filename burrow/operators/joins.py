"""Joins of series with logs, tables and one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.series import SESSION
from burrow.scratch import written


def as_of(probe: DataFrame, log: DataFrame, key: str, time: str, value: str, out: str, order: str) -> DataFrame:
    """probe with the last value of log at or before its time; null before the first.

    Both sides are stacked and one window carries values forward, so the join costs one exchange
    and one sort and no pair is ever made. Log rows sort before probe rows of the same time; among
    themselves rows of one time keep the order of the column ``order``.
    """
    left = probe.select("*", F.lit(1).alias("is_probe"), F.lit(None).cast(log.schema[value].dataType).alias("held_value"), F.col(order).alias("asof_order"))
    right = log.select(F.col(key), F.col(time), F.lit(0).alias("is_probe"), F.col(value).alias("held_value"), F.col(order).alias("asof_order")).where(F.col(value).isNotNull() & F.col(time).isNotNull())
    w = Window.partitionBy(key).orderBy(F.asc_nulls_first(time), "is_probe", "asof_order").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(out, F.last("held_value", ignorenulls=True).over(w))
    return both.where("is_probe = 1").withColumn(out, F.when(F.col(time).isNotNull(), F.col(out))).drop("is_probe", "held_value", "asof_order")


def mapped_clock(probe: DataFrame, anchors: DataFrame, key: str, time: str, other: str, out: str, order: str) -> DataFrame:
    """The other clock at each probe time: the last anchor's, plus what passed since; null before the first anchor."""
    packed = anchors.withColumn("anchor", F.struct(F.col(time).alias("t"), F.col(other).alias("other")))
    return as_of(probe, packed, key, time, "anchor", "anchor", order).withColumn(out, F.col("anchor.other") + (F.col(time) - F.col("anchor.t"))).drop("anchor")


def merged_states(own: DataFrame, log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join: the own value wins, the log fills; ``agree`` is null unless both have one."""
    a, b = own.select(*keys, F.col(value).alias("own_value")), log.select(*keys, F.col(value).alias("log_value"))
    return a.join(b, keys, "full").withColumn(value, F.coalesce("own_value", "log_value")).withColumn("agree", F.when(F.col("own_value").isNotNull() & F.col("log_value").isNotNull(), F.col("own_value") == F.col("log_value")))


def aligned(frames: DataFrame, times: DataFrame, number: str, time: str, fps: float | None = None) -> DataFrame:
    """Left look-up of measured times by frame number; frames beyond them get null, or number / fps where no time was measured at all."""
    out = frames.join(times.select(SESSION, number, time), [SESSION, number], "left")
    if fps:
        none = F.max(F.col(time).isNotNull()).over(Window.partitionBy(SESSION))
        out = out.withColumn(time, F.when(none, F.col(time)).otherwise(F.col(number) * 1000.0 / fps))
    return out


def attached(rows: DataFrame, sheet: DataFrame, key: str, order: str) -> DataFrame:
    """Left join of a sheet on the key as text; of duplicate sheet rows the last by ``order`` wins."""
    last = sheet.withColumn(key, F.trim(F.col(key).cast("string"))).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rank = 1").drop("rank", order)
    return rows.withColumn(key, F.trim(F.col(key).cast("string"))).join(last, key, "left")


def laddered(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[list[tuple[str, str]]]) -> DataFrame:
    """left_id, right_id, tier: each left row's match by the first tier that has one, ties to the smallest right_id.

    A tier is a list of pairs of columns, left and right, that must be equal. The right side is reduced to its smallest id per key of a
    tier before the join, so a key that is frequent on both sides makes no pairs.
    """
    found = None
    for i, pairs in enumerate(tiers):
        keys = [f"key_{k}" for k in range(len(pairs))]
        least = right.groupBy(*(F.col(r).alias(k) for k, (_, r) in zip(keys, pairs))).agg(F.min(right_id).alias(right_id))
        t = left.select(left_id, *(F.col(c).alias(k) for k, (c, _) in zip(keys, pairs))).join(least, keys).select(left_id, right_id, F.lit(i).alias("tier"))
        found = t if found is None else found.unionByName(t)
    best = found.groupBy(left_id).agg(F.min(F.struct("tier", right_id)).alias("best"))
    return best.select(left_id, f"best.{right_id}", "best.tier")


def unmatched(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't among the known ones."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_anti")


def named(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Adds names by key; an unknown key is its own name."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))


def quantile(values: DataFrame, value: str, share: float) -> DataFrame:
    """quantile: the value at a share of all (between two ranks on the straight line), in one row; null without any.

    Values are counted, and the counts dealt out by ranges of them; the ranks lie where the ranges before leave off. So no task holds more than its range.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = written(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "quantile")
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("size"))  # a row a range
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("size").over(Window.partitionBy()))
    ends = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.coalesce("before", F.lit(0))
    ranked = dealt.join(F.broadcast(before.select("part", "before", "all")), "part").withColumn("ends", ends)
    at = share * (F.col("all") - 1)
    holds = lambda rank: (F.col("ends") - F.col("n") <= rank) & (rank < F.col("ends"))
    ranked = ranked.where(holds(F.floor(at)) | holds(F.ceil(at)))
    low, high = F.min("v"), F.max("v")
    return ranked.agg((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias("quantile"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """One row that compares two runs point by point: how many share a key, how many only one has, and mean, 95th percentile and largest distance."""
    left, right = (d.select(*keys, F.col(x).alias(f"{x}_{n}"), F.col(y).alias(f"{y}_{n}"), F.lit(True).alias(f"in_{n}")) for d, n in ((a, "a"), (b, "b")))
    both = F.col("in_a") & F.col("in_b")
    far = F.when(both, F.sqrt(F.pow(F.col(f"{x}_a") - F.col(f"{x}_b"), 2) + F.pow(F.col(f"{y}_a") - F.col(f"{y}_b"), 2)))
    j = written(left.join(right, keys, "full").select("in_a", "in_b", far.alias("far")), "parity")
    out = j.agg(F.count(F.when(both, 1)).alias("shared"), F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"), F.avg("far").alias("mean_px"), F.max("far").alias("max_px"))
    return out.withColumn("p95_px", quantile(j, "far", 0.95).scalar()).select("shared", "only_a", "only_b", "mean_px", "p95_px", "max_px")


def folded(frames: DataFrame, events: DataFrame, time: str, name: str, order: str) -> DataFrame:
    """frames with names: those of events since the frame opened, in order, joined by a bar; events before the first frame go to it."""
    marks = frames.select(SESSION, time, F.col(order).alias("opened"), F.lit(0).alias("is_event"), F.lit(None).cast("string").alias("told"), F.lit(None).cast("long").alias("told_order"))
    told = events.select(SESSION, time, F.lit(None).cast("long").alias("opened"), F.lit(1).alias("is_event"), F.col(name).alias("told"), F.col(order).cast("long").alias("told_order"))
    w = Window.partitionBy(SESSION).orderBy(time, "is_event")
    both = marks.unionByName(told).withColumn("frame_of", F.coalesce(F.last("opened", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("opened").over(Window.partitionBy(SESSION))))
    lists = both.where("is_event = 1").groupBy(SESSION, F.col("frame_of").alias(order)).agg(F.array_sort(F.collect_list(F.struct(F.col(time), "told_order", "told"))).alias("all"))
    return frames.join(lists.select(SESSION, order, F.array_join(F.transform("all", lambda e: e["told"]), "|").alias("names")), [SESSION, order], "left").fillna("", ["names"])
