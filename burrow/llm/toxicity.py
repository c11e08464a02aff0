"""Toxicity from a lexicon of stems, matched through Levenshtein automata, and the words around a match.

``fit`` learns the lexicon from labelled rows (at most about ``most_rows``, a documented bound of the
classifier's sample): prefixes of 4 to 8 letters that stand in ``least_contexts`` different word
neighbourhoods of toxic texts, and either never in the others or at a rate that is surely a multiple
of theirs. That is judged twice, on all places and on those outside quotation, and one is
enough: a term that the others quote or report often is learned, and the regression weighs its
quotations. Counting neighbourhoods keeps the rare words of a much copied text out; rates count a
text by its first neighbourhood, which copies and near copies share. ``Automaton`` is the intersection of
the stems' trie with Levenshtein automata: its states are sets of (trie node, errors), made when a
word first needs them, so matching a word is a walk of table look-ups that stops at the first letter no
stem allows. A spelled match is a stem with any ending. A misspelled one is a whole word near a stem or near
a word of its family: the words of any length that start with the stem and stand in ``least_contexts``
neighbourhoods of toxic texts. Of 5 letters and more one edit is allowed, of more than 8 two.

Each match is then weighed by its window: inside quotation marks, or with a reporting word among
the six words before it, it counts as quotation, else as abuse. A logistic regression on these
counts gives the score.

Defined results: a null or empty text gets the score of a text without matches; rows with a null
label aren't learned from; without any labelled row every score is 0; repeated rows are scored
each; an empty table gives no rows, and empty labels a model of no terms; other columns are ignored by ``fit`` and handed on by ``score``; whole
texts of any length are looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import alnum_words, column, prepare, written

STEM_LENGTHS = range(4, 9)
SPELLED, MISSPELLED = 1, 2
#: Words that report what somebody else said, in the corpus' languages.
REPORTING = frozenset(
    "said says say called calls wrote writes quoted quotes quote quoting reads replied "
    "dit écrit appelle citation zitat sagte schrieb nannte dijo escribió llamó cita".split()
)
QUOTES = re.compile('["“”„«»]')
WINDOW = 6
N_FEATURES = 6
#: Ends a whole word among the prefixes; no word holds it.
END = " "
#: What a place of a form is: outside quotation, the form's first in its text, the first outside quotation.
OPEN, FIRST, FIRST_OPEN = 1, 2, 4
#: A stem that clean texts have too must be this many times as frequent in toxic ones, by so many standard errors.
LEAST_RATIO, ERRORS = 4.0, 2.0


#: Dashes, quotation marks and the like beyond ASCII, as UTF-8.
MARKS = re.compile(rb"\xe2\x80[\x90-\xbf]|\xc2[\xab\xbb]")


def words_of(text: bytes | None) -> list[bytes]:
    """alnum_words, parted by punctuation beyond ASCII too."""
    if text and (b"\xe2\x80" in text or b"\xc2" in text):
        text = MARKS.sub(b" ", text)
    return alnum_words(text)


def allowed_errors(stem: str) -> int:
    return 0 if len(stem) < 5 else 1 if len(stem) <= 8 else 2


class Automaton:
    """Levenshtein automata of all stems at once, determinised as words walk it."""

    def __init__(self, stems: list[str], most_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # errors allowed at a stem's end
        self.reach: list[int] = [0]  # the most errors that a stem below allows
        for stem in stems:
            at = 0
            self.reach[0] = max(self.reach[0], allowed_errors(stem))
            for c in stem:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], allowed_errors(stem))
            self.ends[at] = allowed_errors(stem)
        self.most_states = most_states
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """The state of these places and all that skipping stem letters reaches; -1 if there is none."""
        todo, seen = list(places), set()
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or (node, e) in seen:
                continue
            seen.add((node, e))
            todo += [(x, e + 1) for x in self.children[node].values()]
        best = {}
        for node, e in seen:
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            done = [e for node, e in key if 0 <= e <= self.ends[node]]
            self.accepts.append(0 if not done else SPELLED if min(done) == 0 else MISSPELLED)
        return self.number[key]

    def step(self, state: int, c: str) -> int:
        to = self.steps[state].get(c)
        if to is None:
            places = set()
            for node, e in self.sets[state]:
                places.add((node, e + 1))
                for letter, x in self.children[node].items():
                    places.add((x, e + (letter != c)))
            to = self.steps[state][c] = self._state(places)
        return to

    def match(self, word: str) -> int:
        """SPELLED if the word starts with a stem, MISSPELLED if the whole word is within a stem's allowed errors, else 0."""
        if len(self.sets) > self.most_states:
            self._reset()
        state = self.start
        for c in word:
            state = self.step(state, c)
            if state < 0:
                return 0
            if self.accepts[state] == SPELLED:
                return SPELLED
        return self.accepts[state]


class Matches(dict):
    """Word (bytes) -> match, remembered but for long ones; frequent words came early and stay."""

    LONG = 64

    def __init__(self, automaton: Automaton, most: int = 1_000_000):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        m = self.automaton.match(word.decode().lower())
        if len(word) > self.LONG:
            return m
        if len(self) >= self.most:
            for late in list(self)[self.most // 2 :]:
                del self[late]
        self[word] = m
        return m


def _quoted(line: str, own: list[bytes]) -> list[bool]:
    """Whether each of the line's words stands inside quotation marks or soon after a reporting word."""
    spoken = [w.decode().lower() for w in own]
    depth, inside = 0, []  # quotation marks before each word
    for piece in QUOTES.split(line):
        inside += [depth % 2 == 1] * len(words_of(piece.encode()))
        depth += 1
    closed = depth % 2 == 1 and len(inside) == len(own)
    return [(closed and inside[i]) or not REPORTING.isdisjoint(spoken[max(0, i - WINDOW) : i]) for i in range(len(own))]


def _matches(stems: list[str], words: list[str]) -> Matches:
    """Each of words starts with a stem, so what starts with it is a spelled match already and it adds misspelled ones only."""
    return Matches(Automaton([*stems, *words]))


def _features(text: bytes | None, matches: Matches) -> list[float]:
    """Counts of (spelled, misspelled) x (abuse, quotation) as log(1 + n), abuse per 100 words, and 1."""
    words = words_of(text)
    found = list(map(matches.__getitem__, words))
    if not any(found):
        return [0.0] * (N_FEATURES - 1) + [1.0]
    n = [0, 0, 0, 0]
    at = 0
    for line in text.decode().split("\n"):
        own = words_of(line.encode())
        kinds = found[at : at + len(own)]
        at += len(own)
        if not any(kinds):
            continue
        for k, quoted in zip(kinds, _quoted(line, own)):
            if k:
                n[2 * (k - 1) + quoted] += 1
    return [*np.log1p(n), 100.0 * (n[0] + n[2]) / (len(words) + 20), 1.0]


def _prefixes(word: bytes) -> list[str]:
    w = word.decode().lower()
    out = [w[:k] for k in STEM_LENGTHS if len(w) >= k]
    if allowed_errors(w):
        out.append(w + END)
    return out


def _places(text: bytes | None, wanted: set[str] | None = None) -> dict[tuple[str, int], int]:
    """(prefix, hash of the neighbours) -> OPEN, FIRST and FIRST_OPEN; the prefix "" stands for any word, a word and END for it alone.

    First means the smallest hash. With wanted, only these prefixes and their firsts.
    """
    words = words_of(text)
    if not words:
        return {}
    quoted: list[bool] = []
    for line in text.decode().split("\n"):
        quoted += _quoted(line, words_of(line.encode()))
    out: dict[tuple[str, int], int] = {}
    first: dict[str, int] = {}
    first_open: dict[str, int] = {}
    for i, word in enumerate(words):
        around = xxhash.xxh64_intdigest((words[i - 1] if i else b"") + b" " + (words[i + 1] if i + 1 < len(words) else b"")) >> 1
        prefixes = _prefixes(word)
        if wanted is not None:
            prefixes = [p for p in prefixes if p in wanted]
        else:
            for p in prefixes:
                out[p, around] = out.get((p, around), 0) | (0 if quoted[i] else OPEN)
        for p in ("", *prefixes):
            if around <= first.get(p, around):
                first[p] = around
            if not quoted[i] and around <= first_open.get(p, around):
                first_open[p] = around
    for smallest, bit in ((first, FIRST), (first_open, FIRST_OPEN)):
        for p, around in smallest.items():
            out[p, around] = out.get((p, around), 0) | bit
    return out


@dataclass
class Counts:
    """Of one prefix: neighbourhoods and independent texts, each of all places and of those outside quotation."""

    places: int = 0
    open_places: int = 0
    texts: int = 0
    open_texts: int = 0


@dataclass
class Model:
    """Stems, the weights of the features and the whole words of the stems' families; most_rows bounds the labelled rows that fit learned from."""

    stems: list[str] = field(default_factory=list)
    weights: list[float] | None = None
    words: list[str] = field(default_factory=list)

    def matches(self) -> Matches:
        return _matches(self.stems, self.words)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -40, 40)))


def _surely_more(n: int, total: int, other: int, other_total: int) -> bool:
    """n of total is surely LEAST_RATIO times as frequent as other of other_total."""
    if not other:
        return True
    if not n:
        return False
    return math.log(n / total) - math.log(other / other_total) - ERRORS * math.sqrt(1 / n + 1 / other) >= math.log(LEAST_RATIO)


def _choose(toxic: dict[str, Counts], clean: dict[str, Counts], least_contexts: int) -> list[str]:
    """Shortest prefixes that mark toxic texts, each lengthened while one longer prefix has nearly all its places."""
    a, c = toxic.pop("", Counts()), clean.pop("", Counts())
    none = Counts()

    def marks(p: str) -> bool:
        x, y = toxic[p], clean.get(p, none)
        anywhere = x.places >= least_contexts and _surely_more(x.texts, a.texts, y.texts, c.texts)
        return anywhere or (x.open_places >= least_contexts and _surely_more(x.open_texts, a.open_texts, y.open_texts, c.open_texts))

    pure = {p for p in toxic if not p.endswith(END) and marks(p)}
    stems: set[str] = set()
    for p in sorted(pure, key=lambda p: (len(p), p)):
        if any(p[:k] in pure for k in range(1, len(p))):
            continue
        while longer := [q for q in pure if len(q) == len(p) + 1 and q.startswith(p) and toxic[q].places >= 0.9 * toxic[p].places]:
            p = longer[0]
        stems.add(p)
    return sorted(stems)


def _family(stems: list[str], forms: Iterable[str]) -> list[str]:
    """The whole words among the forms that start with a stem."""
    known = set(stems)
    whole = {p[: -len(END)] for p in forms if p.endswith(END)}
    return sorted(w for w in whole - known if any(w[:k] in known for k in STEM_LENGTHS))


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, least_contexts: int = 5) -> Model:
    """Learns from the texts of labelled documents; labels has doc_id and toxic, about most_rows of them are used."""
    spark = prepare(docs.sparkSession)
    own = labels.select(column(labels, "doc_id", "long"), column(labels, "toxic", "int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # labels that contradict each other: the larger one holds
    total = own.count()
    if not total:
        return Model()
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_rows / total)))
    texts = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    sample = written(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")  # most_rows small rows

    def counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen: dict[tuple[str, int], int] = {}
                for text in b.column(0).cast(pa.binary()).to_pylist():
                    for k, bits in _places(text, wanted).items():
                        seen[k] = seen.get(k, 0) | bits
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([h for _, h in seen], pa.int64()), pa.array(list(seen.values()), pa.int32())], names=["prefix", "around", "bits"])

        once = rows.mapInArrow(places, "prefix string, around long, bits int").groupBy("prefix", "around").agg(F.bit_or("bits").alias("bits"))
        having = lambda bit: F.count_if(F.col("bits").bitwiseAND(bit) != 0)
        return once.groupBy("prefix").agg(F.count("*").alias("places"), having(OPEN).alias("open_places"), having(FIRST).alias("texts"), having(FIRST_OPEN).alias("open_texts"))

    def collected(counts: DataFrame) -> dict[str, Counts]:
        return {r["prefix"]: Counts(r["places"], r["open_places"], r["texts"], r["open_texts"]) for r in counts.collect()}

    contexts = collected(counted(sample.where("toxic = 1"), None).where((F.col("places") >= least_contexts) | (F.col("prefix") == "")))
    others = collected(counted(sample.where("toxic <> 1"), {p for p in contexts if p and not p.endswith(END)}))
    stems = _choose(contexts, others, least_contexts)
    family = _family(stems, contexts)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _matches(stems, family)
        for b in batches:
            rows = [_features(t, matches) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    learned = sample.mapInArrow(measured, "x array<double>, toxic int").toArrow()
    if not learned.num_rows:
        return Model()
    x, y = np.array(learned["x"].to_pylist()), np.array(learned["toxic"].to_pylist(), float)
    return Model(stems, _regress(x, y), family)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two more columns, score and predicted, over whole texts."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(column(docs, "text", "string").alias("tox_text"), *(docs[c] for c in kept))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = model.matches()  # a task's own: kept by the worker it would take memory from the stages that follow
        for b in batches:
            x = np.array([_features(t, matches) for t in b.column(0).cast(pa.binary()).to_pylist()]).reshape(-1, N_FEATURES)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names[1:], "score", "predicted"])

    return rows.mapInArrow(scored, f"{fields + ', ' if fields else ''}score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns."""
    return score(docs, model).where("predicted = 0").select(*(f"`{c}`" for c in docs.columns))
