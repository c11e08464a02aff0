"""Language identification by cross-parsing entropy.

``fit`` takes a bounded sample of labelled text per language (``sample_chars`` symbols of
it, from about ``sample_docs`` texts) and builds each language's suffix automaton. Read from its root it
accepts exactly the substrings of the sample, so cutting a text greedily into the longest strings
that the automaton accepts is its cross-parsing with that language. The fewer phrases, the closer
the language: phrases x log2(sample length) / length estimates the cross entropy per character, and the
language with the smallest estimate wins, so languages with shorter samples aren't favoured.

The automata become one table, next state and "a new phrase starts" for each state and
symbol. Texts are lower-cased, cut to letters with one separator between words, and parsed whole. The
``LETTERS`` commonest letters are one symbol each; any other letter is its code point in digits, so no two letters are
one, in whatever script. Symbols are laid out in lanes of ``LANE`` which numpy walks side by side.
Where a text has several lanes, each is walked again from the state in which the one before it ended; most parses fall into step within
a lane, so that settles nearly all. Lanes that it doesn't settle, as in periodic texts, are walked one after the other from the left, equal lanes
entered in equal states once. The result is that of one parse from the first symbol to the last, in time proportional to the text.

Defined results: null, empty and letterless texts are ``und`` with score 0; a language needs a text
with a letter to be learned; without any, all texts are ``und``; equal estimates go to the language with
more labelled rows, then to the smaller name; repeated rows are predicted each; an empty table gives no rows, and an
empty one to learn from a model of no language; other columns are handed on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.textual import column, per_worker, prepare

LANE = 512
#: Rounds of walking lanes side by side again; fewer lanes than ``FEW`` are walked one after the other sooner.
ROUNDS, FEW = 3, 24
#: Symbols: 0 is the separator, then the digits of rare letters' code points, then the common letters, and last the padding.
DIGIT_BITS, DIGITS = 5, 4
LETTERS = 40
SYMBOLS = 1 + (1 << DIGIT_BITS) + LETTERS + 1


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of symbols, from state 0."""
    following: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in symbols:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


@dataclass
class Model:
    """languages in order of preference; common letters; the joint table, 2 x next state + new phrase; each language's root and bits a phrase."""

    languages: list[str]
    letters: str
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        return _symbols(text, self.letters)


def _symbols(text: str, letters: str) -> np.ndarray:
    """Symbols of a text: runs of what isn't a letter are one separator, none stands first."""
    kind = per_worker("letters", _is_letter)
    code = per_worker(f"alphabet {letters}", lambda: _codes(letters))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = kind[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points, letter = points[keep], letter[keep]
    s = np.where(letter, code[points], 0).astype(np.uint8)
    rare = np.flatnonzero(letter & (s == 0))
    if not len(rare):
        return s
    width = np.ones(len(s), np.int64)
    width[rare] = DIGITS
    at = np.cumsum(width) - width
    out = np.repeat(s, width)
    for d in range(DIGITS):
        out[at[rare] + d] = 1 + (points[rare] >> np.uint32(DIGIT_BITS * (DIGITS - 1 - d)) & np.uint32((1 << DIGIT_BITS) - 1))
    return out


def _codes(letters: str) -> np.ndarray:
    code = np.zeros(0x110000, np.uint8)
    for i, c in enumerate(letters):
        code[ord(c)] = 1 + (1 << DIGIT_BITS) + i
    return code


def _tabled(symbols: np.ndarray, base: int) -> np.ndarray:
    """The automaton's table; its last state follows a symbol that the sample lacks, which is a phrase of its own."""
    states = suffix_automaton(symbols.tolist())
    lacking = len(states)
    restart = np.full(SYMBOLS, lacking, np.int32)
    for c, to in states[0].items():
        restart[c] = to
    t = np.empty((lacking + 1, SYMBOLS), np.int32)
    t[:] = 2 * (restart + base) + 1
    t[0] -= 1  # nothing has been read: no phrase to end
    for i, following in enumerate(states):
        for c, to in following.items():
            t[i, c] = 2 * (to + base)
    t[:, SYMBOLS - 1] = 2 * (np.arange(lacking + 1) + base)
    return t


def fit(train: DataFrame, sample_docs: int = 200, sample_chars: int = 30_000) -> Model:
    """Learns from the columns text and lang; per language about sample_docs distinct texts are drawn and sample_chars symbols used.

    Texts are drawn from all distinct ones of a language (all, if they are fewer). A text longer than 4/10 of
    sample_chars gives six pieces of that total length, spread evenly over it. Each text gives up to a tenth of
    sample_chars symbols first; the rest of the texts fills what is then left. The model has about 1.5 x sample_chars
    states a language, 300 bytes each.
    """
    prepare(train.sparkSession)
    none = Model([], "", np.zeros((1, SYMBOLS), np.int32), np.zeros(0, np.int64), np.zeros(0))
    rows = train.select(column(train, "lang", "string"), column(train, "text", "string")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return none
    distinct = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    share = F.create_map(*(x for lang, n in distinct.collect() for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, sample_docs / n))))))
    ticket = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    most, piece = 4 * sample_chars // 10, sample_chars // 15
    apart = F.floor((F.length("text") - piece) / 5).cast("int")
    pieces = F.concat_ws(" ", *(F.substr("text", 1 + i * apart, F.lit(piece)) for i in range(6)))
    drawn = rows.where(ticket < share[F.col("lang")]).select("lang", F.when(F.length("text") > most, pieces).otherwise(F.col("text")).alias("text"), ticket.alias("ticket"))
    texts: dict[str, list[str]] = {}
    for r in sorted(drawn.distinct().collect(), key=lambda r: (r["ticket"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    seen = Counter(c for own in texts.values() for t in own for c in t.lower() if c.isalpha())
    letters = "".join(sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))
    tables, languages, roots, bits, base = [], [], [], [], 0
    for lang in sorted(texts, key=lambda x: (-sizes[x], x)):
        parts = [s for t in texts[lang] if len(s := _symbols(t, letters))]
        if not parts:
            continue
        head = sample_chars // 10
        parts = [p[:head] for p in parts] + [p[head:] for p in parts if len(p) > head]
        joined = np.concatenate([np.append(p, 0) for p in parts])[:sample_chars]
        tables.append(_tabled(joined, base))
        languages.append(lang)
        roots.append(base)
        bits.append(math.log2(len(joined) + 1))
        base += len(tables[-1])
    return Model(languages, letters, np.concatenate(tables), np.array(roots, np.int64), np.array(bits)) if languages else none


def _walk(lanes: np.ndarray, active: np.ndarray, flat: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New phrases in each lane (a column; longest first) entered in the given state, and the state it ends in."""
    state = state.copy()
    count = np.zeros(lanes.shape[1], np.int32)
    for i in range(lanes.shape[0]):
        n = int(active[i])
        if not n:
            break
        step = flat.take(state[:n].astype(np.int64) * SYMBOLS + lanes[i, :n])
        count[:n] += step & 1
        state[:n] = step >> 1
    return count, state


def _settle(lanes: np.ndarray, used: np.ndarray, follows: np.ndarray, root: int, flat: np.ndarray, entry: np.ndarray, counts: np.ndarray, ends: np.ndarray, again: np.ndarray) -> None:
    """Walks from the left what wasn't entered in the state that the lane before ends in; changes counts and ends."""
    cells = memoryview(flat)
    known: dict[tuple[bytes, int], tuple[int, int]] = {}
    done = -1
    for first in again.tolist():
        i = first
        while i > done and i < len(follows):
            state = int(ends[i - 1]) if follows[i] else root
            if state == entry[i]:
                break
            key = lanes[i, : used[i]].tobytes(), state
            if key not in known:
                n, s = 0, state
                for c in key[0]:
                    v = cells[s * SYMBOLS + c]
                    n += v & 1
                    s = v >> 1
                known[key] = n, s
            entry[i] = state
            counts[i], ends[i] = known[key]
            done = i
            i += 1


def phrases(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases of each text's cross-parsing with each language; texts are symbol arrays."""
    lengths = np.array([-(-len(s) // LANE) for s in texts], np.int64)
    lanes = np.full((int(lengths.sum()), LANE), SYMBOLS - 1, np.uint8)
    at = 0
    for s, n in zip(texts, lengths):
        flat = lanes[at : at + n].reshape(-1)
        flat[: len(s)] = s
        at += n
    of = np.repeat(np.arange(len(texts)), lengths)
    follows = np.concatenate([[False], of[1:] == of[:-1]]) if len(of) else np.zeros(0, bool)
    used = (lanes != SYMBOLS - 1).sum(axis=1)
    order = np.argsort(-used, kind="stable")
    place = np.argsort(order)
    rows, lanes = lanes, np.ascontiguousarray(lanes[order].T)
    active = (lanes != SYMBOLS - 1).sum(axis=1)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    flat = model.table.reshape(-1)
    for j, root in enumerate(model.roots):
        entry = np.full(len(of), root, np.int32)
        counts, ends = (x[place] for x in _walk(lanes, active, flat, entry[order]))
        for turn in range(ROUNDS + 1):
            before = np.where(follows, np.concatenate([[root], ends[:-1]]), root).astype(np.int32) if len(of) else entry
            again = np.flatnonzero(before != entry)
            if len(again) < FEW or turn == ROUNDS:
                _settle(rows, used, follows, int(root), flat, entry, counts, ends, again)
                break
            entry = before
            some = again[np.argsort(-used[again], kind="stable")]
            columns = np.ascontiguousarray(lanes[:, place[some]])
            counts[some], ends[some] = _walk(columns, (columns != SYMBOLS - 1).sum(axis=1), flat, entry[some])
        out[:, j] = np.bincount(of, counts, minlength=len(texts)) + (lengths > 0)
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with lang_pred and score: 1 - smallest entropy estimate / smallest of another language."""
    spark = prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(column(docs, "text", "string").alias("lid_text"), *(docs[c] for c in kept))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    shared = spark.sparkContext.broadcast(model)  # languages x 2 x sample_chars states at most

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = [], []
            symbols = [m.symbols(t or "") if m.languages else np.empty(0, np.uint8) for t in b.column(0).to_pylist()]
            table = phrases(symbols, m) * m.bits if m.languages and symbols else np.zeros((len(symbols), 0))
            for s, row in zip(symbols, table):
                if not len(s) or not m.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmin())
                rest = np.delete(row, best)
                langs.append(m.languages[best])
                scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"{fields + ', ' if fields else ''}lang_pred string, score double")
