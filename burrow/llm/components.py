"""Connected components of a link table, by joins and aggregates alone.

Defined results: an empty link table has no components; links of a node to itself and repeated links change nothing;
null ends are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import written

#: Rows of one key are dealt to so many tasks where a key may hold much of a table.
SPREAD = 16


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with the one row that each key has in one; a hot key's rows go to ``SPREAD`` tasks."""
    dealt = many.withColumn("_deal", F.pmod(F.xxhash64(*many.columns), F.lit(SPREAD)).cast("int"))
    copies = one.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copies, [key, "_deal"], how).drop("_deal")


def _followed(up: DataFrame) -> DataFrame:
    """node, up with every path of pointers followed to its end; each round halves the paths."""
    while True:
        # few nodes are pointed to, however many point to each
        targets = up.select(F.col("up").alias("node")).distinct().join(up, "node")
        further = written(targets.where("up <> node").select(F.col("node").alias("up"), F.col("up").alias("further")), "further")
        if further.isEmpty():
            return up
        up = written(spread_join(up, further, "up", "left").select("node", F.coalesce("further", "up").alias("up")), "pointers")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of the links (columns a, b, long): label is the smallest node of its component.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers to
    their ends, and contracts the graph to these: a component of more than one node at least halves, so the rounds are
    no more than the logarithm of the largest component. All tables are written out, so no lineage piles up.
    """
    names = links.select("a", "b").where("a <> b")
    edges = written(names.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), "pointers")
        up = _followed(up)
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            moved = up.withColumnsRenamed({"node": "label", "up": "moved"})
            labels = written(spread_join(labels, moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")), "labels")
        step = spread_join(edges, up.withColumnsRenamed({"node": "a", "up": "ua"}), "a")
        step = spread_join(step, up.withColumnsRenamed({"node": "b", "up": "ub"}), "b").where("ua <> ub")
        edges = written(step.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
