"""A small corpus with everything that goes wrong in large ones."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row long, host string"
SYLLABLES = "ba re ti on er le st un de qua mi sol ke ran vo".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(word(rng) + rng.choice(["", "", "", ",", "."]) + ("\n" if rng.random() < 0.06 else ""))
    return " ".join(out)


def edited(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = word(rng)
    return " ".join(w)


def rows(seed=11, n=60):
    """(doc_id, text, lang, source) with copies, near copies, nulls, empties, long texts, repeated lines and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 3, 5, 30, 120, 300])) for _ in range(n)]
    base = prose(rng, 220)
    texts += [base] * 6 + [edited(rng, base, 0.004) for _ in range(25)] + [edited(rng, base, 0.02) for _ in range(15)]
    boiler = "this line stands in very many documents of a host, again and again"
    texts += [boiler + "\n" + prose(rng, 40) for _ in range(8)] + [boiler] * 2
    texts += ["one two three four five six seven eight nine ten " * 6, "same line here\n" * 5 + prose(rng, 30), "MIT License\nGNU General  Public-License; apache license CC BY mit license mit license", "# $ % & | < > * ##"]
    texts += [None, "", "   \n\t ", "É È   ü", "x", prose(rng, 5000), "\x00 nul \x1c sep   line", "日本語 テキスト 。", "a\tb\x0bc\x0cd\re"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[5], "en", "s0"), (None, None, None, None)]
    return out


def frame(spark, data):
    full = [(i, t, lang, src, len(t) if t else None, "clash", 7, "clash") for i, t, lang, src in data]
    return spark.createDataFrame(full, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
