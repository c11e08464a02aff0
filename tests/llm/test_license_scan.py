import re

import corpus

from burrow.llm import license_scan
from burrow.llm.textual import alnum_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(data):
    out = []
    for key, t, *_ in data:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at, labels = [], set()
        for p in license_scan.PHRASES:
            q = p.text.split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    at.append(k)
                    labels.add(p.label)
        out.append((key, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return sorted(out, key=repr)


def test_base_places(spark):
    data = corpus.rows()
    got = license_scan.scan(corpus.frame(spark, data)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data)


def test_notices_with_words_put_in_and_left_out(spark):
    mit = license_scan.NOTICES[0].text.split()
    changed = mit[:20] + ["really"] + mit[20:30] + mit[32:]
    data = [(1, "intro " + " ".join(changed) + " outro", "en", "s"), (2, " ".join(mit[:9]), "en", "s"), (3, "nothing of the kind", "en", "s")]
    got = {r["doc_id"]: r for r in license_scan.scan(corpus.frame(spark, data)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and 0.5 <= got[1]["score"] <= 1
    assert got[2]["labels"] == "" and got[3]["score"] == 0


def test_templates_are_words():
    assert all(t.words == alnum_words(t.text.lower().encode()) for t in license_scan.PHRASES)


def test_empty_table(spark):
    assert license_scan.scan(corpus.nothing(spark)).count() == 0


def test_long_texts_come_in_pieces(spark, monkeypatch):
    data = corpus.rows(n=20) + [(9000, ("w " * 700 + "mit license ") * 3, "en", "s0")]
    want = sorted(map(tuple, license_scan.scan(corpus.frame(spark, data)).collect()), key=repr)
    monkeypatch.setattr(license_scan, "PIECE", 7)
    monkeypatch.setattr(license_scan, "SENT", 100)
    assert sorted(map(tuple, license_scan.scan(corpus.frame(spark, data)).collect()), key=repr) == want
    assert [r[2:5] for r in want if r[0] == 9000] == [(3, 700, 2104)]
