import random

import corpus
import numpy as np
import pytest

from burrow.llm import langid

LANGUAGES = {"aa": "ba re ti on er le st".split(), "bb": "qua mi sol ke ran vo ü".split(), "cc": "zo pi xa tru öß wy".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + rng.choice(["", ".", " 12!"])


def parse(symbols, sample):
    """Phrases of the greedy cross-parsing with a string, by substring search."""
    n, i = 0, 0
    while i < len(symbols):
        k = 1
        while i + k < len(symbols) and symbols[i : i + k + 1] in sample:
            k += 1
        n += 1
        i += k
    return n


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(2)
    s = [rng.randint(0, 3) for _ in range(60)]
    states = langid.suffix_automaton(s)
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(3000):
        q = tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 6)))
        at = 0
        for c in q:
            at = states[at].get(c, -1)
            if at < 0:
                break
        assert (at >= 0) == (q in subs)


@pytest.mark.parametrize("lane", [5, 64, 4096])
def test_phrases_equal_substring_search(spark, monkeypatch, lane):
    """Whole texts are one parse, however they are laid out; with letters that a sample lacks."""
    rng = random.Random(3)
    monkeypatch.setattr(langid, "LANE", lane)
    samples = {lang: langid._symbols(" ".join(text(rng, lang, 40) for _ in range(5)) + ".", "abeiklmnoqrst") for lang in LANGUAGES}
    tables, roots = [], []
    for s in samples.values():
        roots.append(sum(map(len, tables)))
        tables.append(langid._tabled(s, roots[-1]))
    model = langid.Model(list(LANGUAGES), "abeiklmnoqrst", np.concatenate(tables), np.array(roots), np.ones(3))
    odd = ["ж", "жж ba", "ba ж re", "日本語", "b", "ßß öl"]
    texts = [model.symbols(t) for t in [text(rng, lang, 20) for lang in LANGUAGES for _ in range(5)] + odd]
    got = langid.phrases(texts, model)
    for j, s in enumerate(samples.values()):
        assert got[:, j].tolist() == [parse(bytes(t), bytes(s)) for t in texts]


def test_letters_beyond_the_common_ones_are_told_apart(spark):
    rng = random.Random(4)
    one, two = [chr(c) for c in range(0x4E00, 0x4E00 + 400)], [chr(c) for c in range(0x5E00, 0x5E00 + 400)]
    say = lambda letters: "".join(rng.choice(letters[:: rng.choice([1, 7])]) for _ in range(60))
    model = langid.fit(spark.createDataFrame([(lang, say(x)) for lang, x in (("xx", one), ("yy", two)) for _ in range(80)], "lang string, text string"))
    docs = spark.createDataFrame([(lang, say(x)) for lang, x in (("xx", one), ("yy", two)) for _ in range(20)], "lang string, text string")
    assert all(r["lang"] == r["lang_pred"] for r in langid.predict(docs, model).collect())
    assert len({bytes(model.symbols(c)) for c in one + two}) == 800


def test_a_short_sample_is_not_favoured(spark):
    rng = random.Random(6)
    rows = [("aa", text(rng, "aa", 60)) for _ in range(80)] + [("bb", text(rng, "bb", 12))] * 3
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(lang, text(rng, lang, 30)) for lang in ("aa", "bb") for _ in range(20)], "lang string, text string")
    assert all(r["lang"] == r["lang_pred"] for r in langid.predict(docs, model).collect())


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang, rng.choice([3, 20, 300])), lang, "s") for i, lang in enumerate(sorted(LANGUAGES) * 40)]
    model = langid.fit(corpus.frame(spark, rows[:60] + [(900, None, "aa", "s"), (901, "x y", None, "s"), (902, "", "dd", "s")]))
    assert set(model.languages) == set(LANGUAGES)
    odd = [(1000, None, None, None), (1001, "", None, None), (1002, "12 ...", None, None), (1003, "日本", None, None)]
    got = {r["doc_id"]: r for r in langid.predict(corpus.frame(spark, rows[60:] + odd), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[60:]) >= 58
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in LANGUAGES
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels(spark):
    model = langid.fit(corpus.nothing(spark))
    assert {r["lang_pred"] for r in langid.predict(corpus.frame(spark, corpus.rows()), model).collect()} == {"und"}
    assert langid.predict(corpus.nothing(spark), model).count() == 0


def test_much_copied_language_is_learned(spark):
    rng = corpus.random.Random(8)
    few = [" ".join(rng.choice(["zuk", "wym", "pfo", "gax"]) for _ in range(60)) for _ in range(3)]
    rows = [("en", corpus.prose(rng, 60)) for _ in range(50)] + [("xx", few[i % 3]) for i in range(60_000)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(model.languages) == ["en", "xx"]
    got = langid.predict(spark.createDataFrame([("zuk wym gax pfo zuk zuk",)], "text string"), model).collect()
    assert got[0]["lang_pred"] == "xx"


def test_long_texts_leave_room_for_others(spark):
    long = [("en", c * 12_000) for c in "abcdefgh"]
    model = langid.fit(spark.createDataFrame(long, "lang string, text string"))
    root = model.table[model.roots[0]]
    assert all(not root[model.symbols(c)[0]] & 1 for c in "abcdefgh")


def walked(symbols, model, root):
    """Phrases by one walk through the table, symbol by symbol."""
    state, n = int(root), 1
    for c in symbols.tolist():
        step = int(model.table[state, c])
        n, state = n + (step & 1), step >> 1
    return n


@pytest.fixture(scope="module")
def sampled():
    rng = random.Random(5)
    tables, roots = [], []
    for lang in LANGUAGES:
        roots.append(sum(map(len, tables)))
        tables.append(langid._tabled(langid._symbols(" ".join(text(rng, lang, 40) for _ in range(40)), "abeiklmnoqrstu"), roots[-1]))
    return langid.Model(list(LANGUAGES), "abeiklmnoqrstu", np.concatenate(tables), np.array(roots), np.ones(3))


@pytest.mark.parametrize("unit", ["the ", "w", "la la ", "que de la ", "ba re ", "bareti on qua ", "ж "])
def test_periodic_texts_are_parsed_as_one(sampled, unit):
    """Periods that never fall into step with the lanes, alone and between others."""
    rng = random.Random(6)
    strings = [unit * 3000, text(rng, "aa", 900) + " " + unit * 2000 + text(rng, "bb", 700), unit * 400 + "x" + unit * 1500]
    texts = [sampled.symbols(t) for t in strings]
    got = langid.phrases(texts, sampled)
    for j, root in enumerate(sampled.roots):
        assert got[:, j].tolist() == [walked(t, sampled, root) for t in texts]


def test_repetitive_texts_take_no_longer(sampled):
    import time

    rng = random.Random(7)
    ordinary = text(rng, "aa", 250_000)[:1_000_000]

    def seconds(t):
        symbols = sampled.symbols(t)
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            langid.phrases([symbols], sampled)
            best = min(best, time.perf_counter() - start)
        return best

    assert max(seconds(u * (1_000_000 // len(u))) for u in ("the ", "ha ", "que de la ")) < 3 * seconds(ordinary) + 0.05
