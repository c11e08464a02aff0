"""N-gram Jaccard join: all documents whose word-shingle sets are similar enough, and their components.

Texts with equal shingle sets form one class and are handled once. Links between classes are found
by T-occurrence searches with DivideSkip (``Index.search``): a block of classes has an inverted
index; a query's short lists are merged with a heap, candidates that could still reach the required
overlap are looked up in the long lists by binary search, and those that reach it are linked.
Shingles that have the same list in a block share one list with a weight.

Which blocks a query must search comes from part signatures (``signatures``): the space of shingle hashes is
cut into more parts than two similar sets can have unlike shingles, so some parts hold the same
shingles in both; a signature is the hash of all a part holds. Of its signatures, in a common order, a set
needs only the first quarter or so of its size, and similar classes have several of those in common. A
signature stands for several shingles at once, so classes that merely share common phrases or a passage
seldom meet, at any size of the corpus. The steps, each a Spark job over whole tables:

1. Read all texts: class (a 64-bit hash of the set) and set size of each document.
2. Signatures that two texts share, found in packed form: each batch of texts sends its signatures as sorted differences
   of 32 bits to slots of the hash space, some two or three bytes each.
3. Texts with enough shared signatures send these with their class; signatures of one class alone go. Each
   class goes to the family of the smallest class it meets, and families are split into blocks of about
   ``BLOCK`` classes, each with the family's first class.
4. Each block is searched in itself until all classes outside its largest component have been queries.
5. Components so far. Classes that share enough signatures with a family that holds a larger
   component are queries to its blocks; signatures within one component need no more search. That keeps groups
   of thousands of near copies from being compared in pairs, and loses no link between components.
6. Components of all links.

Groups are never gathered whole: hot signatures and classes are only aggregated or joined, blocks have a
bounded number of classes, and a block with many queries is copied for every few hundred of them.
Distinct sets meeting in one 64-bit hash are expected 24 times in 3 x 10^10 documents; shingles likewise.

Defined results: a null, empty or blank text has the empty set, links with nothing and is its own component;
repeated rows share their component; a component without any doc_id has a null id; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.llm.components import components, spread_join
from burrow.llm.textual import WordHashes, column, mixed, per_worker, prepare, released, rolling, written

SHINGLE = 5
BLOCK = 400
QUERIES_PER_TASK = 400
#: A filter has eight bits a key or more, and at most 2^29 (64 MB); for more keys rows are joined unfiltered.
MOST_FILTER_BITS = 29
#: Signatures a slot holds, and slots a task reads.
SLOT_KEYS = 1 << 20
SLOTS_PER_TASK = 8
#: Classes a task searches, so that tasks grow in number and not in length.
CLASSES_PER_TASK = 4_000


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words, or of all its words if it has fewer."""
    words = hashes.of(text)
    if not len(words):
        return words
    k = min(size, len(words))
    return np.unique(rolling(words, k) ^ np.uint64(k))


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of sorted hashes, and for each how many of its kind a similar set must share at least.

    A pair is looked for in the bucket of its smaller size (sizes from 2^j to 2^(j + 1) - 1), so a set
    has signatures for the buckets of all partners that are not larger. In a bucket:
    the hash space has a fixed number of parts; similar sets differ in at most ``apart`` shingles, so at most in
    as many parts. Of the others some may be empty in both: at least ``common`` parts hold the same and something.
    Each set keeps its smallest ``apart + goal`` signatures, ``goal`` being the bucket's and the same for all its sets:
    at most ``apart`` of a set's are unshared, so both keep the ``goal`` smallest shared ones, or all if there are
    fewer. A set with ``common`` below the goal is sure of that many only, and asks for no more.
    A set with too many empty parts (``common`` < 1) can only miss sets of the same kind; these get single shingles of a
    prefix, too, of which similar sets share one.
    """
    n = len(s)
    found, needs = [], []
    for j in range((-(-percent * n // 100)).bit_length() - 1, n.bit_length()):
        most = (2 << j) - 1
        apart = min(n, most) * (100 - percent) // percent
        parts = max(1, -(-4 * most * (100 - percent) // (3 * percent)))
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        signed = mixed(np.add.reduceat(s, starts) ^ mixed(part[starts] + np.uint64(parts << 32)))
        common, goal = len(starts) - apart, -(-(3 << j) // 40)
        if common > goal:
            signed = np.sort(signed)[: apart + goal]
        elif common < 1:
            prefix = s[: n - -(-percent * n // 100) + 1]
            signed = np.concatenate([signed, mixed(prefix ^ np.uint64(parts))])
        found.append(signed)
        needs.append(np.full(len(signed), max(1, min(common, goal)), np.int32))
    return np.concatenate(found), np.concatenate(needs)


class Index:
    """Inverted lists of one block's sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], owner[by]
        self.tokens, starts = np.unique(tokens, return_index=True)
        ends = np.append(starts[1:], len(tokens))
        # shingles with equal lists share one: compare lists by the sum of a random number per member
        numbers = np.random.default_rng(5).integers(0, 1 << 63, len(sets), np.uint64)
        sums = np.add.reduceat(numbers[owner], starts) if len(starts) else np.empty(0, np.uint64)
        _, first, self.list_of = np.unique(sums, return_index=True, return_inverse=True)
        self.lists = [owner[starts[i] : ends[i]].tolist() for i in first]

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """The members whose overlap with the query is large enough, by DivideSkip."""
        n = len(query)
        least = -(-percent * n // 100)
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        hit = at[self.tokens[at] == query] if len(self.tokens) else at[:0]
        if len(hit) < least:
            return []
        which, weight = np.unique(self.list_of[hit], return_counts=True)
        lists = sorted(zip((self.lists[i] for i in which), weight.tolist()), key=lambda x: (-len(x[0]), x[1]))
        # long lists: together they can't reach the overlap alone, so each candidate is in a short one
        held, cut = 0, 0
        while cut < len(lists) and held + lists[cut][1] < least:
            held += lists[cut][1]
            cut += 1
        long = lists[:cut]
        counts: dict[int, int] = {}
        streams = [[(m, w) for m in members] for members, w in lists[cut:]]
        for member, w in heapq.merge(*streams):
            counts[member] = counts.get(member, 0) + w
        out = []
        for member, c in counts.items():
            size = self.sizes[member]
            need = -(-percent * (n + size) // (100 + percent))
            left = held
            if 100 * min(n, size) < percent * max(n, size):
                continue
            for members, w in long:
                if c + left < need:
                    break
                left -= w
                i = bisect_left(members, member)
                if i < len(members) and members[i] == member:
                    c += w
            if c >= need:
                out.append(member)
        return out


def block_links(sets: list[np.ndarray], percent: int, index_of: Callable = Index) -> list[tuple[int, int]]:
    """Links that connect the members of each component of one block, and no more than that.

    Sets are queries one after the other until some component is found, then all sets outside
    the component with the most sets that weren't queries, until one component holds all of these.
    """
    index = index_of(sets)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []
    waiting = list(range(len(sets)))
    while True:
        # a link between two sets that are never queries joins nothing new if they are in one component
        members: dict[int, list[int]] = {}
        for q in waiting:
            members.setdefault(find(q), []).append(q)
        if len(members) < 2:
            return out
        spared = max(members, key=lambda r: len(members[r]))
        if len(members[spared]) == 1:
            ready = [waiting[0]]
        else:
            ready = [q for r, own in members.items() if r != spared for q in own]
        for q in ready:
            for member in index.search(sets[q], percent):
                a, b = find(q), find(member)
                if a != b:
                    root[b] = a
                    out.append((q, member))
        done = set(ready)
        waiting = [q for q in waiting if q not in done]


@dataclass(frozen=True)
class Search:
    """How near copies are looked for: the words of a shingle, the least similarity, what stands for a set in the search for candidates, and the index of a block.

    ``tokens`` gives a set's tokens and for each the least number of them that it shares with any similar set.
    """

    size: int
    percent: int
    tokens: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
    index: Callable[[list[np.ndarray]], object]

    def set_of(self, text: bytes | None) -> np.ndarray:
        return shingle_set(text, per_worker("run hashes", lambda: WordHashes("run")), self.size)


class BitFilter:
    """A bit table for hashes, in proportion to their number; what isn't set isn't among them.

    Only the highest ``kept`` bits of a hash count; two places are looked up, from their higher and their lower end.
    """

    def __init__(self, keys: DataFrame, name: str, bits: int, kept: int):
        self.bits, self.kept = bits, kept
        self.words = np.zeros(1 << max(0, bits - 6), np.uint64)
        low = F.shiftrightunsigned(name, 64 - kept).bitwiseAND((1 << bits) - 1)
        cells = keys.select(F.explode(F.array(F.shiftrightunsigned(name, 64 - bits), low)).alias("bit"))
        cells = cells.selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, cast(bit & 63 AS int)) AS v")
        for b in cells.groupBy("word").agg(F.bit_or("v").alias("v")).toArrow().to_batches():  # at most 2^23 pairs of numbers
            self.words[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)

    @staticmethod
    def of(keys: DataFrame, name: str, kept: int = 64) -> BitFilter | None:
        """A filter of a written table's column, or None if it would be too large to send to all workers."""
        bits = max(20, (8 * keys.count() - 1).bit_length())
        return BitFilter(keys, name, bits, kept) if bits <= MOST_FILTER_BITS else None

    def among(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), np.uint64)
        for bit in (keys >> np.uint64(64 - self.bits), keys >> np.uint64(64 - self.kept) & np.uint64((1 << self.bits) - 1)):
            out &= self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))
        return (out & np.uint64(1)).astype(bool)


def pack(keys: np.ndarray, slot_bits: int) -> Iterator[tuple[int, bytes]]:
    """Sorted keys by slot (their highest bits): differences of the 32 bits below, first all lowest bytes, then all next ones and so on."""
    keys = np.sort(keys)
    keys = keys[np.concatenate([np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]])]  # twice is enough
    slot = keys >> np.uint64(63 - slot_bits) >> np.uint64(1)
    low = (keys >> np.uint64(32 - slot_bits)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    steps = np.diff(low, prepend=np.uint32(0))
    steps[starts] = low[starts]
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        yield int(slot[a]), steps[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(packed: list[bytes]) -> np.ndarray:
    """The 32 bits of all keys of one slot."""
    return np.concatenate([np.cumsum(np.frombuffer(p, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0], dtype=np.uint32) for p in packed])


def _read(docs: DataFrame, how: Search) -> DataFrame:
    """doc_id, text_hash, n_shingles, class of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, classes = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = how.set_of(t)
                sizes.append(len(s))
                classes.append(class_of(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], names=["doc_id", "text_hash", "n_shingles", "class"])

    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"), F.xxhash64(column(docs, "text", "string")).alias("text_hash"))
    return rows.mapInArrow(read, "doc_id long, text_hash long, n_shingles long, class long")


def _signed_batch(texts: pa.Array, how: Search) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Class, set size, tokens and their needs of each class among the texts that has any."""
    seen: set[int] = set()
    for t in texts.cast(pa.binary()).to_pylist():
        s = how.set_of(t)
        c = class_of(s)
        if len(s) and c not in seen:
            seen.add(c)
            tokens, needs = how.tokens(s, how.percent)
            if len(tokens):
                yield c, len(s), tokens, needs


def _shared(docs: DataFrame, how: Search, slot_bits: int) -> DataFrame:
    """key: the highest 32 + slot_bits bits of signatures that two texts have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s for _, _, s, _ in _signed_batch(b.column(0), how)]
            rows = list(pack(np.concatenate(found), slot_bits)) if found else []
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["slot", "packed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in _grouped(batches, 2):
            low = np.sort(unpacked([r[0] for r in rows]))
            twice = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.uint64)
            keys = (np.uint64(slot) << np.uint64(63 - slot_bits) << np.uint64(1)) | (twice << np.uint64(32 - slot_bits))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    sent = docs.select(column(docs, "text", "string")).mapInArrow(send, "slot long, packed binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << slot_bits) // SLOTS_PER_TASK)
    return sent.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(find, "key long")


def _signed(docs: DataFrame, how: Search, among: BitFilter | None) -> DataFrame:
    """token, class, n, need: signatures of texts that have enough of them in among, and only these; all if among is None."""
    shared = docs.sparkSession.sparkContext.broadcast(among)  # at most 2^26 bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            tokens, classes, sizes, needs, counts = [np.empty(0, np.uint64)], [], [], [], []
            for c, n, found, need in _signed_batch(b.column(0), how):
                if f is not None:
                    found = found[f.among(found)]
                if len(found) >= need.min():
                    tokens.append(found)
                    classes.append(c)
                    sizes.append(n)
                    needs.append(need.min())
                    counts.append(len(found))
            each = [pa.array(np.repeat(np.array(x, kind), counts)) for x, kind in ((classes, np.int64), (sizes, np.int32), (needs, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *each], names=["token", "class", "n", "need"])

    return docs.select(column(docs, "text", "string")).mapInArrow(cut, "token long, class long, n int, need int").groupBy("token", "class").agg(F.first("n").alias("n"), F.first("need").alias("need"))


def _sets(docs: DataFrame, rows: DataFrame, classes: DataFrame, how: Search) -> DataFrame:
    """class, shingles of the classes, each once. rows: what ``_read`` gives; one text stands for its class."""
    texts = written(rows.groupBy("class").agg(F.min("text_hash").alias("text_hash")).join(classes, "class"), "class-texts")
    shared = docs.sparkSession.sparkContext.broadcast(BitFilter.of(texts, "text_hash"))  # at most 2^26 bytes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            chosen = b.column(0) if f is None else b.column(0).filter(pa.array(f.among(b.column(1).to_numpy().view(np.uint64))))
            found: dict[int, np.ndarray] = {}
            for t in chosen.cast(pa.binary()).to_pylist():
                s = how.set_of(t)
                if len(s):
                    found.setdefault(class_of(s), s)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], names=["class", "shingles"])

    text = column(docs, "text", "string")
    sent = docs.select(text, F.xxhash64(text).alias("text_hash")).mapInArrow(send, "class long, shingles binary")
    return sent.groupBy("class").agg(F.first("shingles").alias("shingles"))


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Runs of rows with equal first column, from sorted batches: the key and the rows' other columns."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns[:width])):
            if rows and r[0] != key:
                yield key, rows
                rows = []
            key = r[0]
            rows.append(r[1:])
    if rows:
        yield key, rows


def _emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def links(docs: DataFrame, rows: DataFrame, how: Search, tokens: int) -> DataFrame:
    """a, b: links between classes of docs, of about so many tokens in all, that connect each of their components. rows: what ``_read`` gives."""
    spark, percent = docs.sparkSession, how.percent
    slot_bits = min(31, max(0, (tokens // SLOT_KEYS).bit_length()))
    shared = written(_shared(docs, how, slot_bits), "shared-signatures")
    own = written(_signed(docs, how, BitFilter.of(shared, "key", 32 + slot_bits)), "own-signatures")
    ends = own.groupBy("token").agg(F.min("class").alias("center"), F.max("class").alias("last")).where("center <> last")
    met = own.join(ends.select("token", "center"), "token")
    enough = met.groupBy("class").agg(F.min("center").alias("family"), F.first("n").alias("n"), F.first("need").alias("need"), F.count("*").alias("held")).where("held >= need")
    family = written(enough.select("class", "n", "family"), "families")

    count = family.groupBy("family").agg(F.count("*").alias("size"), F.min("class").alias("pivot"))
    placed = spread_join(family, count, "family").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    block = F.xxhash64("family", F.pmod(F.xxhash64("class"), F.col("blocks")))
    placed = written(placed.select("class", "n", "family", "pivot", "blocks", block.alias("block")), "blocks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // CLASSES_PER_TASK)
    # the family's first class stands in all its blocks, so each set is dealt out once to all blocks it is in
    others = placed.where("blocks > 1 AND class = pivot").select("class", F.col("block").alias("own"), "family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("i"))
    pivots = others.select("class", "own", F.xxhash64("family", "i").alias("block")).where("block <> own")
    targets = placed.select("class", "block", F.lit(True).alias("home")).unionByName(pivots.select("class", "block", F.lit(False).alias("home")))
    sets = written(_sets(docs, rows, placed.select("class"), how).join(targets, "class"), "sets")
    inside = sets.select("block", "class", "shingles")
    sets = sets.where("home").drop("home")

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            rows.sort(key=lambda r: (len(r[1]), r[0]))
            found = block_links([np.frombuffer(s, np.uint64) for _, s in rows], percent, how.index)
            if found:
                yield _emit([(rows[i][0], rows[j][0]) for i, j in found])

    first = written(inside.repartition(parts, "block").sortWithinPartitions("block", "class").mapInArrow(search_blocks, "a long, b long"), "links-inside")

    # what is left: signatures shared by several components
    labels = components(first)
    known = placed.select("class", "family", "block").join(labels.withColumnsRenamed({"node": "class"}), "class", "left").select("class", "family", "block", F.coalesce("label", "class").alias("label"))
    sized = known.groupBy("label").agg(F.count("*").alias("size"))
    known = written(spread_join(known, sized, "label").select("class", "family", "block", F.struct("size", "label").alias("rank")), "ranked")
    labelled = written(own.join(known, "class"), "labelled")
    torn = labelled.groupBy("token").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo <> hi").select("token")
    # a link to another component shows in so many of a class's signatures, all of them torn
    among_torn = labelled.join(torn, "token")
    able = among_torn.groupBy("class", "need").agg(F.count("*").alias("shared")).where("shared >= need").select("class")
    open_members = written(among_torn.join(able, "class"), "open-members")
    # of two components the smaller one asks: members of the largest one in a signature ask nobody
    sides = open_members.groupBy("token", F.col("family").alias("asked")).agg(F.max("rank").alias("top"), F.min("n").alias("small"), F.max("n").alias("large"))
    alike = (100 * F.col("large") >= percent * F.col("n")) & (percent * F.col("small") <= 100 * F.col("n"))
    asks = open_members.join(sides, "token").where(F.col("rank") < F.col("top")).where(alike)
    asks = asks.groupBy("class", "rank", "n", "need", F.col("block").alias("home"), F.col("asked").alias("family")).agg(F.count("*").alias("shared")).where("shared >= need")
    # a family asked is all its blocks asked that have a larger component
    blocks = open_members.groupBy("family", "block").agg(F.max("rank").alias("top"), F.min("n").alias("small"), F.max("n").alias("large"))
    asks = asks.join(blocks, "family").where("block <> home AND rank < top").where(alike).select("class", "rank.label", "block").distinct()
    asks = written(asks, "queries")
    if asks.isEmpty():
        return first
    tasks = asks.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("copies"))
    key = lambda i: F.xxhash64("block", i)
    indexed = sets.join(tasks, "block").join(known.select("class", "rank.label"), "class").select("block", "class", "label", "shingles", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("i"))
    indexed = indexed.select(key(F.col("i")).alias("task"), F.lit(0).alias("asks"), "class", "label", "shingles")
    asked = asks.join(tasks, "block").join(sets.select("class", "shingles"), "class")
    asked = asked.select(key(F.pmod(F.xxhash64("class"), F.col("copies")).cast("int")).alias("task"), F.lit(1).alias("asks"), "class", "label", "shingles")

    def search_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 5):
            held = [r for r in rows if not r[0]]
            index = how.index([np.frombuffer(r[3], np.uint64) for r in held])
            found = {}
            for _, c, label, s in (r for r in rows if r[0]):
                for i in index.search(np.frombuffer(s, np.uint64), percent):
                    if held[i][2] != label:
                        found[c, held[i][2]] = held[i][1]
            if found:
                yield _emit([(c, b) for (c, _), b in found.items()])

    across = indexed.unionByName(asked).repartition(parts, "task").sortWithinPartitions("task", "asks", "class").mapInArrow(search_asked, "a long, b long")
    return first.unionByName(written(across, "links-across"))


def joined(docs: DataFrame, how: Search, tokens: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id per row. tokens: about how many a set of so many shingles has."""
    prepare(docs.sparkSession)
    with released():
        rows = written(_read(docs, how), "shingle-classes", keep=True)
        count = rows.agg(F.sum(tokens(F.col("n_shingles"))).cast("long").alias("n")).first()["n"] or 0
        labels = components(links(docs, rows, how, count))
        least = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
        named = least.join(labels.withColumnsRenamed({"node": "class"}), "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
        smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
        named = written(spread_join(named, smallest, "label").select("class", "component_id"), "components", keep=True)
    out = rows.join(named, "class", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _joined(docs: DataFrame, percent: int) -> DataFrame:
    return joined(docs, Search(SHINGLE, percent, signatures, Index), lambda n: F.floor(n / 2))


def join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per row: documents link when 100 x intersection >= percent x union of their shingle sets."""
    return _joined(docs, percent).drop("text_hash")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns; rows without shingles stay.

    Of repeated rows (equal doc_id and text) one stays. Rows without a doc_id stay only if their component has no id.
    """
    rows = written(_joined(docs, percent), "classified")
    found = rows.where("n_shingles > 0 AND component_id IS NOT NULL AND (doc_id IS NULL OR doc_id <> component_id)")
    gone = written(found.select(F.col("doc_id").alias("nj_id"), F.col("text_hash").alias("nj_hash")).distinct(), "copies")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["nj_id"]) & (F.xxhash64(column(docs, "text", "string")) == gone["nj_hash"])
    kept = docs.join(gone, same, "left_anti")
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
