import random

import corpus

from burrow.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    stems = ["abba", "abcab", "bacca", "cabbacabb", "aabbccaab"]
    a = toxicity.Automaton(stems)
    for _ in range(6000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        if any(w.startswith(s) for s in stems):
            want = toxicity.SPELLED
        else:
            want = toxicity.MISSPELLED if any(distance(w, s) <= toxicity.allowed_errors(s) for s in stems) else 0
        assert a.match(w) == want, w


def test_small_state_limit_changes_nothing():
    words = ["abcab", "abxab", "zzz", "abca", "abcabx"]
    big, small = toxicity.Automaton(["abcab"]), toxicity.Automaton(["abcab"], most_states=1)
    assert [big.match(w) for w in words] == [small.match(w) for w in words]


def labelled(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        t, bad = corpus.prose(rng, rng.choice([15, 60])), i % 4 == 0
        w = t.split(" ")
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(["grubnik", "plumfex", "grubnikos", "plumfexen"]))
        elif i % 8 == 1:
            w.insert(3, '"grubnik"')
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_stems_and_tells_quotation_from_abuse(spark):
    rows, labels = labelled()
    train = spark.createDataFrame([x for x in labels if x[0] % 5] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(corpus.frame(spark, rows), train)
    assert any("grubnik".startswith(s) for s in model.stems) or any("plumfex".startswith(s) for s in model.stems)
    got = {r["doc_id"]: r for r in toxicity.score(corpus.frame(spark, rows), model).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.9 * len(held)


def test_edges(spark):
    rows, labels = labelled(120)
    model = toxicity.fit(corpus.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = corpus.rows()
    scored = toxicity.score(corpus.frame(spark, odd), model)
    assert scored.count() == len(odd) and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    docs = corpus.frame(spark, rows + odd)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.score(corpus.nothing(spark), model).count() == 0


def test_misspelling_counts():
    m = toxicity.Matches(toxicity.Automaton(["plumfex"]))
    x = toxicity._features(b"you plumfx and plumfexes", m)
    assert x[0] > 0 and x[2] > 0 and x[1] == x[3] == 0
    q = toxicity._features('she said “plumfex” today, "plumfex"'.encode(), m)
    assert q[1] > 0 and q[0] == 0


def test_learns_terms_that_clean_texts_quote(spark):
    rows, labels = labelled()
    model = toxicity.fit(corpus.frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"))
    assert all(any(t.startswith(s) for s in model.stems) for t in ("grubnik", "plumfex"))
    extra = [(5000, "you grubnik go away", "en", "s"), (5001, 'it has "grubnik" in it', "en", "s")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(corpus.frame(spark, rows + extra), model).collect()}
    assert (got[5000], got[5001]) == (1, 0)
    held = [i for i, y in labels if i % 5 == 0 and i % 8 == 1]
    assert held and not any(got[i] for i in held)


def test_rates_of_a_term_in_clean_texts():
    toxic = {"": toxicity.Counts(0, 0, 100, 100), "rare": toxicity.Counts(60, 60, 60, 60), "even": toxicity.Counts(60, 60, 60, 60)}
    clean = {"": toxicity.Counts(0, 0, 800, 800), "rare": toxicity.Counts(90, 9, 90, 9), "even": toxicity.Counts(400, 400, 400, 400)}
    assert toxicity._choose(toxic, clean, 5) == ["rare"]


def test_long_terms_are_caught_misspelled(spark):
    rng = random.Random(4)
    terms = ["worthless", "disgusting"]
    rows = [(i, f"{corpus.prose(rng, 20)} {rng.choice(terms) if i % 2 else 'fair'} {corpus.prose(rng, 20)}", "en", "s") for i in range(200)]
    # some are misspelled in the training texts too, each in another way, so that the regression can weigh it
    slips = [t[:k] + "x" + t[k + 1 :] for t in terms for k in range(1, 8)]
    rows += [(1000 + k, f"{corpus.prose(rng, 20)} {w} {corpus.prose(rng, 20)}", "en", "s") for k, w in enumerate(slips)]
    labels = [(i, int(i >= 1000 or i % 2)) for i, *_ in rows]
    model = toxicity.fit(corpus.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(terms) <= set(model.words)
    matches = model.matches()
    wrong = [b"worhtless", b"wrthless", b"worthlss", b"disgsting", b"disgutsing", b"dsgustin"]
    assert [matches[w] for w in wrong] == [toxicity.MISSPELLED] * len(wrong)
    assert matches[b"worthlessness"] == toxicity.SPELLED and matches[b"disgrace"] == matches[b"worth"] == 0
    new = [(i, f"{corpus.prose(rng, 20)} {w.decode()} {corpus.prose(rng, 20)}", "en", "s") for i, w in enumerate(wrong)]
    scored = toxicity.score(corpus.frame(spark, new), model).collect()
    assert all(r["predicted"] == 1 for r in scored)
