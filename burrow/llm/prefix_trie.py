"""Prefix trie of conversations: which starts are shared, and what sharing them saves.

A node is a distinct sequence of the first d turns (role and text), the root the empty one. Subtree totals come by leaf-peeling
message passing (``peeled``): every node holds a counter of children that aren't finished; a node without any is
finished and sends its totals to its parent, until only the root is left and finishes.

- Text is read once: a turn goes on as its role, the MD5 of its text and its length.
- A node's key is the exclusive or of hashes of its turns' places and contents, twice 64 bits. Such sums can be cut anywhere, so a conversation
  may be longer than a task can take: rows are dealt out by ranges of (conversation, turn), numbered and summed within a range, and what earlier
  ranges hold is added. Only a conversation at a border has earlier ranges, so these additions are no more than there are ranges.
- A node of a single conversation has one leaf and saves nothing, down to its end; it is finished from the start.
- A node that waits for one child only needs that child's totals: it points to the child, and pointers to nodes of the same
  kind are followed, each round twice as far. So the rounds grow with the logarithm of the trie and not with its depth.
- Every round's table is written to the shared folder.

Defined results: a null role or text is empty; turns are ordered by number, null first, turns of one number by role and then by the MD5 of
the text; rows without conv_id belong to no conversation; repeated rows are turns of their own; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.llm.textual import column, prepare, released, written

#: Range of ids that are joined to one string before they are digested.
CHUNK = 10_000
_NOTHING = hashlib.sha256(b"").hexdigest()


def _ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("row")]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), range, role, mark, chars: each turn's place; range: where its rows were dealt to."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(column(conversations, c, "string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.select(column(conversations, "conv_id", "long"), column(conversations, "turn", "long"), role.alias("role"), F.md5(text).alias("mark"), F.length(text).cast("long").alias("chars"))
    slim = written(slim.where("conv_id IS NOT NULL"), "turns").withColumn("row", F.monotonically_increasing_id())
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(slim.repartitionByRange(ranges, "conv_id", *_ordered()).withColumn("range", F.spark_partition_id()), "dealt-turns")
    here = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*_ordered()))
    before = _before(dealt, before=(F.count("*"), F.sum))
    out = dealt.withColumn("here", here).join(F.broadcast(before), ["conv_id", "range"], "left")
    return out.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "range", "role", "mark", "chars")


def _before(rows: DataFrame, **sums: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """conv_id, range and for each name what the conversation's earlier ranges hold, where there are any; at most one row for each border between ranges.

    sums: the aggregate of a range's rows, and the one of the ranges.
    """
    over = rows.groupBy("conv_id").agg(F.min("range").alias("first"), F.max("range").alias("last")).where("first < last")
    parts = rows.join(F.broadcast(over), "conv_id").groupBy("conv_id", "range", "first").agg(*(here.alias(n) for n, (here, _) in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv_id", "range", "first", *(total(n).over(earlier).alias(n) for n, (_, total) in sums.items())).where("range > first").drop("first")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their start from another one, from numbered turns: ids (conv_id, length, range) and turns (conv_id, pos, length, range, role, mark, chars).

    Conversation c gets the first h turns of c - c % block and then its own after its first h, with h = crc32(c) % most.
    """
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("range").alias("range"))
    start = F.col("conv_id") - F.col("conv_id") % block
    known = size.select("conv_id", "n", "range", start.alias("start"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    held = size.select(F.col("conv_id").alias("start"), F.col("n").alias("there"))
    known = known.join(held, "start", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    known = written(known.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt-ids")
    # a start serves as many conversations as there are ids in its block, with fewer than `most` turns each
    starts = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("start"), "pos", "role", "mark", "chars")
    taken = known.join(starts, "start").where("pos <= h").select("conv_id", "pos", "length", "range", "role", "mark", "chars")
    own = turns.join(known.select("conv_id", "h", "taken", "length"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "length", "range", "role", "mark", "chars")
    return known.select("conv_id", "length", "range"), taken.unionByName(own)


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and turns of the conversations as they stand."""
    ids = written(turns.groupBy("conv_id").agg(F.count("*").alias("length"), F.min("range").alias("range")), "ids")
    return ids, turns.join(ids.select("conv_id", "length"), "conv_id")


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, pos, length, chars, a, b, pa, pb: the key of the node that each turn leads to, and its parent's."""
    turns = turns.withColumn("x", F.xxhash64("pos", "role", "mark")).withColumn("y", F.xxhash64("mark", "role", "pos"))
    turns = written(turns.drop("role", "mark"), "rebuilt-turns")
    so_far = Window.partitionBy("conv_id", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = _before(turns, bx=(F.bit_xor("x"), F.bit_xor), by=(F.bit_xor("y"), F.bit_xor))
    out = turns.withColumn("a", F.bit_xor("x").over(so_far)).withColumn("b", F.bit_xor("y").over(so_far)).join(F.broadcast(before), ["conv_id", "range"], "left")
    out = out.withColumn("a", F.col("a").bitwiseXOR(F.coalesce("bx", F.lit(0)))).withColumn("b", F.col("b").bitwiseXOR(F.coalesce("by", F.lit(0))))
    return out.select("conv_id", "pos", "length", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: of the node's ids (conv_id, each once), ascending and joined by commas.

    Ids are joined in chunks of one range of numbers each; a task then passes the chunks of its nodes through the digest, one after the other.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, hashlib.sha256(), []
        for batch in batches:
            for a, b, chunk in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (a, b):
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(chunk.encode())
            yield _digests(out)
            out = []
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("a", "b", F.expr(f"conv_id div {CHUNK}").alias("bucket")).agg(ids.alias("chunk"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "bucket").mapInArrow(digest, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, s = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=["a", "b", "ends_sha256"])


_KEY = ["a", "b"]


def peeled(tree: DataFrame) -> DataFrame:
    """a, b, leaves, saved: subtree totals of every node.

    tree: a, b (key), pa, pb (parent's key), open (children not finished), ca, cb (exclusive or of their keys), leaves and saved
    (the node's own and its finished children's). A node that waits for one child has its key in ca, cb.
    """
    # a node that waits for one child points to it (ta, tb)
    points = lambda c: F.when(F.col("open") == 1, F.col(c))
    state = written(tree.withColumn("ta", points("ca")).withColumn("tb", points("cb")), "trie-round")
    columns, finished = state.columns, []
    while True:
        done, waiting = state.where("open = 0"), state.where("open > 0")
        finished.append(done.select("a", "b", "leaves", "saved"))
        if waiting.isEmpty():
            break
        # messages to parents that wait for several children
        sent = done.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n"), F.bit_xor("a").alias("ma"), F.bit_xor("b").alias("mb"), F.sum("leaves").alias("ml"), F.sum("saved").alias("ms"))
        several = waiting.where("ta IS NULL").join(sent, _KEY, "left")
        more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        less = lambda c, m: F.col(c).bitwiseXOR(F.coalesce(m, F.lit(0))).alias(c)
        several = several.select("a", "b", "pa", "pb", (F.col("open") - F.coalesce("n", F.lit(0))).cast("long").alias("open"), less("ca", "ma"), less("cb", "mb"), more("leaves", "ml"), more("saved", "ms"))
        several = several.withColumn("ta", points("ca")).withColumn("tb", points("cb"))
        # what a pointer's target has: totals if it finished, else its own pointer if it waits for one, too, and not for a finished one
        target = done.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("leaves").alias("tl"), F.col("saved").alias("ts"))
        single = waiting.where("ta IS NOT NULL").join(target, ["ta", "tb"], "left")
        single = single.withColumn("open", F.when(F.col("tl").isNull(), F.col("open")).otherwise(F.lit(0)).cast("long"))
        single = single.select("a", "b", "pa", "pb", "open", "ca", "cb", more("leaves", "tl"), more("saved", "ts"), "ta", "tb")
        next_ = single.where("open > 0").select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("ta").alias("na"), F.col("tb").alias("nb"), F.col("leaves").alias("nl"), F.col("saved").alias("ns"))
        jumped = single.where("open > 0").join(next_, ["ta", "tb"], "left").select("a", "b", "pa", "pb", "open", "ca", "cb", more("leaves", "nl"), more("saved", "ns"), F.coalesce("na", "ta").alias("ta"), F.coalesce("nb", "tb").alias("tb"))
        state = written(several.unionByName(jumped).unionByName(single.where("open = 0")).select(*columns), "trie-round")
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def trie(conversations: DataFrame, block: int | None = None, most: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    The conversations as they stand, or ``rebuilt`` with starts from one of their block. A conversation names the nodes that it is the
    smallest member of; a turn saves its length in code points for each further conversation.
    """
    prepare(conversations.sparkSession)
    with released():
        turns = written(numbered(conversations), "numbered-turns")
        ids, turns = as_they_are(turns) if block is None else rebuilt(turns, block, most)
        paths = written(_paths(turns), "paths")
        nodes = paths.groupBy("a", "b").agg(F.min("pos").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        root = ids.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        root = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"), none.alias("pa"), none.alias("pb"))
        nodes = written(nodes.unionByName(root), "trie-nodes")
        # a child of one conversation is finished; n_convs - 1 is 0 just there
        alone = F.col("n_convs") == 1
        kids = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.count_if(alone).alias("finished"), F.bit_xor(F.when(~alone, F.col("a"))).alias("ca"), F.bit_xor(F.when(~alone, F.col("b"))).alias("cb"))
        nodes = nodes.join(kids, _KEY, "left")
        number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        nodes = written(nodes.withColumns({c: number(c) for c in ("n_children", "finished", "ca", "cb")}).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "trie-counted")
        leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("finished")).cast("long")
        tree = nodes.where("n_convs > 1").select("a", "b", "pa", "pb", (F.col("n_children") - F.col("finished")).alias("open"), "ca", "cb", leaves.alias("leaves"), F.col("own").alias("saved"))
        totals = peeled(tree).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
        ended = paths.where("pos = length").select("a", "b", "conv_id").unionByName(ids.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
        parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(totals, _KEY, "left").join(end_digests(ended), _KEY, "left").join(parents, ["pa", "pb"], "left")
        out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
        return written(out, "trie", keep=True)
