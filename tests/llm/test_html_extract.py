import random
import re
import time

import numpy as np
import pytest

from burrow.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.fit()


def text(model, page):
    return model.texts([page])[0]


def judged(model, pages):
    """Share of pages that come out exactly, of main characters that are kept and of others that are let through."""
    exact, kept, main, let, other = 0, 0, 0, 0, 0
    for root in pages:
        nodes = H.nodes_of(root)
        got, want = H.decode(nodes, model.trees.margins(H.features(nodes, model.odds))), np.array([n.main for n in nodes])
        own = np.array([sum(len(p[0].strip()) for p in n.parts if not isinstance(p, H.Node)) for n in nodes])
        exact += H.text_of(nodes, got) == H.text_of(nodes, want)
        kept, main = kept + own[want & got].sum(), main + own[want].sum()
        let, other = let + own[~want & got].sum(), other + own[~want].sum()
    return exact / len(pages), kept / main, let / other


@pytest.mark.parametrize("style,exact,let", [("named", 0.85, 0.02), ("foreign", 0.75, 0.04), ("bare", 0.6, 0.06), ("made-up", 0.6, 0.06), ("misleading", 0.65, 0.04)])
def test_held_out_pages(model, style, exact, let):
    got = judged(model, H.teaching_pages(150, 4242, (style,)))
    print(style, got)
    assert got[0] >= exact and got[1] >= 0.98 and got[2] <= let


def unlike_pages():
    """Pages of templates that have nothing to do with the teaching ones: page, paragraphs of the article, boilerplate strings."""
    rng = random.Random(77)
    words = "river stone market letter winter engine garden silver captain window music harbour evening doctor valley bridge paper summer island forest".split()
    say = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    prose = lambda: " ".join(say(rng.randint(6, 18)) for _ in range(rng.randint(2, 6)))
    out = []
    for i in range(60):
        ps = [prose() for _ in range(rng.choice([3, 6, 12, 90]))]
        junk = [say(4) + f" j{i}n{k}" for k in range(6)]
        anchors = "".join(f'<a href="/x{k}">{rng.choice(words)}</a> | ' for k in range(8))
        kind = i % 6
        if kind == 0:  # tables for layout
            body = f'<table><tr><td colspan=2>{anchors}{junk[0]}</td></tr><tr><td width=160><font>{anchors}</font><br>{junk[1]}</td><td>{"".join(f"<p>{p}</p>" for p in ps)}</td></tr></table><div id="foot">{junk[2]}</div>'
        elif kind == 1:  # a wiki
            body = f'<div id="mw-head"><ul>{"".join(f"<li><a href=#>{rng.choice(words)}</a></li>" for _ in range(9))}</ul></div><div class="mw-parser-output">{"".join(f"<h2>{say(3)}</h2><p>{p}</p>" for p in ps)}</div><div id="catlinks">{anchors}</div><div class="footer-places">{junk[0]}</div>'
        elif kind == 2:  # a blog of nested wrappers
            body = f'<div class="wrap"><div class="site-nav">{anchors}</div><div class="columns"><div class="column"><div class="blogpost">{"".join(f"<div class=graf><p>{p}</p></div>" for p in ps)}</div><div class="share-buttons">{anchors}</div><div class="comment-thread"><div>{junk[0]}</div><div>{junk[1]}</div></div></div><div class="column sidebar-right"><h4>{junk[2]}</h4>{anchors}</div></div></div>'
        elif kind == 3:  # a forum-like page, no class names
            body = f'<nav>{anchors}</nav><main>{"".join(f"<p>{p}</p>" for p in ps)}</main><aside><p>{junk[0]}</p></aside><footer><p>{junk[1]}</p></footer>'
        elif kind == 4:  # news with promos inside
            mid = len(ps) // 2
            body = f'<header role="banner"><ul>{"".join(f"<li><a href=#>{rng.choice(words)}</a></li>" for _ in range(7))}</ul></header><div class="story-body">{"".join(f"<p>{p}</p>" for p in ps[:mid])}<aside class="promo-box"><p>{junk[0]}</p></aside>{"".join(f"<p>{p}</p>" for p in ps[mid:])}</div><div class="newsletter-signup"><form><input><p>{junk[1]}</p></form></div><div class="legal">{junk[2]}</div>'
        else:  # paragraphs by line breaks
            body = f'<div id="menu">{anchors}</div><div id="content">{"<br><br>".join(ps)}</div><div id="cookie-bar">{junk[0]} <a href=#>ok</a></div>'
        held = [j for j in junk if j in body]
        out.append((f"<html><head><title>{junk[5]}</title></head><body>{body}</body></html>", ps, held))
    return out


NAME = re.compile(r"(class|id|role)=(\"[^\"]*\"|[\w-]+)")


@pytest.mark.parametrize("names", ["given", "none", "numbers", "finnish"])
def test_templates_left_out_of_teaching(model, names):
    """With their names, without any, with meaningless ones, and with ones of a language that isn't taught."""
    rng = random.Random(78)
    other = {"given": lambda m: m[0], "none": lambda m: "", "numbers": lambda m: f'{m[1]}="x{rng.randint(1, 999)}"', "finnish": lambda m: f'{m[1]}="{rng.choice(["laatikko", "palsta", "osasto", "kehys", "alue"])}"'}[names]
    kept = asked = let = junk = 0
    for page, ps, held in unlike_pages():
        got = text(model, NAME.sub(other, page))
        kept += sum(p in got for p in ps)
        asked += len(ps)
        let += sum(j in got for j in held)
        junk += len(held)
    print(f"{names}: paragraphs kept {kept} of {asked}, boilerplate let through {let} of {junk}")
    assert kept >= 0.95 * asked and let <= 0.05 * junk


SAID = "<p>The river runs through the silver valley in the evening, and a captain waits.</p>"


@pytest.mark.parametrize("part,has", [(f'<div class="commentary">{SAID}{SAID}</div>', 7), (f'<section class="related-work"><h2>Work</h2>{SAID}{SAID}</section>', 7), (f'<div class="more">{SAID}</div>', 6)])
def test_parts_of_an_article_stay_under_misleading_names(model, part, has):
    page = f'<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>Title of it</h1>{SAID * 3}{part}{SAID * 2}</article><footer><p>Copyright 2024</p></footer></body></html>'
    got = text(model, page)
    assert got.count("silver valley") == has and "Copyright" not in got and "Home" not in got


def test_formulas_stay(model):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{SAID * 3}<p>We have <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> here, as was to be shown.</p></article></body></html>"
    assert "We have x=2 here, as was to be shown." in text(model, page)


def test_names_of_another_language(model):
    page = f'<html><body><div class="kopf"><ul><li><a href=/>Start</a></li><li><a href=/n>Neues</a></li></ul></div><div class="inhalt"><h1>Titel</h1>{SAID * 4}</div><div class="kommentare"><h3>Meinungen</h3><div><b>Hans</b><p>Gut gesagt.</p></div></div><div class="fuss"><p>Alle Rechte vorbehalten</p></div></body></html>'
    got = text(model, page)
    assert got.count("silver valley") == 4 and not any(w in got for w in ("Neues", "Meinungen", "Gut gesagt", "Rechte"))


@pytest.mark.parametrize("make", [lambda n: "<div>" + "<p>some words</p>" * n + "</div>", lambda n: "<div>" * n + "</b></span></section>" * n, lambda n: "<p x='" * n, lambda n: '<a title="' + "<b x='>" * n, lambda n: "<svg>" * n + "words", lambda n: "<ul>" + "<li>x" * n, lambda n: "<table>" + "<tr><td>y" * n, lambda n: "<i " * n])
def test_large_pages_take_time_in_proportion(model, make):
    took = []
    for n in (4_000, 32_000):
        start = time.process_time()
        text(model, make(n))
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 1


def test_a_page(model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>A title of some words</h1><p><b>First &amp; foremost,   said the man.<br><p>Second paragraph &#233; with &nbsp;spaces, of a certain length, so that it reads as prose.</p></article>
    <section class="comments"><h2>Comments</h2><p>Nice one!</p></section><footer>&copy; 2024</footer></body></html>"""
    assert text(model, page) == "A title of some words\n\nFirst & foremost, said the man.\n\nSecond paragraph é with spaces, of a certain length, so that it reads as prose."


def test_decoding_has_no_kept_element_below_a_dropped_one():
    rng = np.random.default_rng(1)
    for root in H.teaching_pages(30, 5):
        nodes = H.nodes_of(root)
        m = rng.normal(0, 2, len(nodes))
        kept = H.decode(nodes, m)
        index = {id(n): i for i, n in enumerate(nodes)}
        assert all(kept[index[id(n.parent)]] for n, k in zip(nodes, kept) if k and n.parent is not None)
        # no other allowed choice of one flipped subtree is likelier
        score = lambda k: float(np.where(k, -np.logaddexp(0, -m), -np.logaddexp(0, m)).sum())
        for i, n in enumerate(nodes):
            below = {i}
            for j in range(i + 1, len(nodes)):
                if index[id(nodes[j].parent)] in below:
                    below.add(j)
            if kept[i]:
                other = kept.copy()
                other[list(below)] = False
                assert score(other) <= score(kept) + 1e-9


@pytest.mark.parametrize("page", [None, "", "plain words", "<", "<p", "<div><div><div>", "</p></p>", "<!-- open", "<script>never closed", "<a href='x>'>t</a>", "<p>a<table><tr><td>b</p>c", "\x00<b>x"])
def test_odd_pages(model, page):
    assert isinstance(text(model, page), str)


def test_rows(spark, model):
    rows = [(1, "u", "<article><p>Some words of an article, long enough to be one.</p></article>", 3), (2, None, None, 4), (2, None, "", 4), (None, "v", "<p>x</p>" * 3000, 5)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 2] == ["", ""]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
