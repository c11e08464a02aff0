"""MinHash near-dedup: bottom-k sketches of word-pair sets, inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds the hashes of its 2-word shingles; its sketch are the ``KEPT`` smallest of them, so one hash
function serves all. Texts with equal sets form one class and are handled once.

Inverted lists of single retained values are long where a word pair is common, so in the search over the whole corpus
lists are kept by runs of ``RUN`` values that stand next to each other in a sketch: what the sketch
of the union holds in a run of shared values, both sketches hold in a run. How many such lists two similar
sets share at least (``least_shared``) follows from their sizes where the sketches hold the sets whole, and
otherwise from the chance of as many shared runs among ``KEPT`` draws, of which each is shared with the least similarity; a pair on the border
is below it with probability ``RISK``, one above the border far less often. Classes whose lists are shared often enough come together in blocks
(``jaccard.links`` says how; no list is cut, and no pairs are made of a list). In a block (``Sketches``):

1. inverted lists of the retained values give the overlap of the query's sketch with all members' sketches;
2. of the members with enough overlap the sketch of the union is made and the similarity estimated from it, as the share of its values
   that both sketches hold; the bound on that share again has the risk ``RISK``. Sets that sketches hold whole need no estimate;
3. what passes is compared on full sets, and linked when 100 x intersection >= percent x union.

Defined results: a null, empty or blank text has the empty set, links with nothing and is its own component; repeated rows
share their component; a row without doc_id is kept if its component has no doc_id either; an empty table gives no rows;
other columns are ignored, also one named like a result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm import jaccard
from burrow.llm.textual import mixed

WORDS = 2
KEPT = 128
RUN = 3
RISK = 1e-9


@lru_cache
def least_shared(run: int, percent: int, kept: int = KEPT, risk: float = RISK) -> int:
    """The largest number c for which ``kept`` values, each shared with the given chance, hold fewer than c runs of ``run`` shared ones only with probability ``risk``."""
    p = percent / 100
    ways = np.zeros((run, kept + 1))  # by shared values just before (at most run - 1) and runs so far
    ways[0, 0] = 1
    for _ in range(kept):
        after = np.zeros_like(ways)
        after[0] = (1 - p) * ways.sum(0)
        after[1:] += p * ways[:-1]
        after[run - 1, 1:] += p * ways[run - 1, :-1]
        ways = after
    return int(np.searchsorted(np.cumsum(ways.sum(0)), risk, side="right"))


def tokens(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a sketch's runs, and the least number of them that the set shares with any similar one.

    Similar sets with ``d`` unlike values share at least ``d * percent / (100 - percent)``, in at most d + 1 pieces, and so many less ``RUN - 1`` each
    are runs. Sets too small to be sure of one also give the single values of a prefix, of which similar sets share one.
    """
    v = s[:KEPT]
    n, other = len(s), (100 - percent) / percent
    # shared - (RUN - 1) * (d + 1), with d <= shared * other and shared >= n * percent / 100
    sure = n * percent / 100 * (1 - (RUN - 1) * other) - (RUN - 1)
    if len(v) >= RUN:
        out = v[: len(v) - RUN + 1].copy()
        for i in range(1, RUN):
            out = mixed(out) + v[i : len(v) - RUN + 1 + i]
        out = mixed(out)
    else:
        out = v[:0]
    if sure <= 0:
        # a set of too few values is like no other
        prefix = s[: n - -(-percent * n // 100) + 1 if n * other >= 1 else 0]
        out = np.concatenate([out, mixed(prefix ^ np.uint64(KEPT))])
    need = max(1, min(int(np.ceil(sure - 1e-9)), least_shared(RUN, percent)))
    return out, np.full(len(out), need, np.int32)


class Sketches:
    """Inverted lists of the values that one block's sketches retain."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate([s[:KEPT] for s in sets]) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), np.minimum(self.sizes, KEPT))
        by = np.argsort(values, kind="stable")
        self.owner = owner[by]
        self.values, self.starts = np.unique(values[by], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))

    def overlaps(self, sketch: np.ndarray) -> np.ndarray:
        """Of each member's sketch with this one."""
        at = np.searchsorted(self.values, sketch)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == sketch]
        lists = [self.owner[a:b] for a, b in zip(self.starts[at], self.ends[at])]
        return np.bincount(np.concatenate(lists), minlength=len(self.sets)) if lists else np.zeros(len(self.sets), np.int64)

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """The members that are similar enough to the query."""
        if not len(self.values) or not len(query):
            return []
        least = least_shared(1, percent)
        sketch, n = query[:KEPT], len(query)
        found = self.overlaps(sketch)
        fits = 100 * np.minimum(self.sizes, n) >= percent * np.maximum(self.sizes, n)
        # what the union's sketch shares is at most the overlap
        need = np.minimum(least, -(-percent * np.maximum(self.sizes, n) // 100))
        out = []
        for i in np.flatnonzero(fits & (found >= need)).tolist():
            other = self.sets[i]
            union = np.concatenate([sketch, other[:KEPT]])
            union.sort()
            twice = union[1:] == union[:-1]
            shared = int(twice.sum())
            if max(n, len(other)) > KEPT:
                ranks = np.cumsum(np.concatenate([[True], ~twice]))
                end = np.searchsorted(ranks, KEPT) + 1  # of the union's sketch
                if twice[:end].sum() < least:
                    continue
                shared = len(np.intersect1d(query, other, assume_unique=True))
            if 100 * shared >= percent * (n + len(other) - shared):
                out.append(i)
        return out


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row: documents link when 100 x intersection >= percent x union of their sets of word pairs."""
    how = jaccard.Search(WORDS, percent, tokens, Sketches)
    out = jaccard.joined(docs, how, lambda n: F.least(n, F.lit(KEPT)))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
