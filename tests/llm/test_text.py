"""Quality, decontamination, licenses, mixing and HTML extraction."""

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from civicspark.llm import decontaminate as dc
from civicspark.llm import html_extract as hx
from civicspark.llm import licenses as lc
from civicspark.llm import mixing as mx
from civicspark.llm import quality as ql

DOCS = "doc_id long, text string, score string"


def labelled(n=240):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(n):
        words = [f"word{rng.integers(0, 300)}" for _ in range(rng.integers(10, 120))]
        good = k % 3 > 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 10)
        rows.append((k, text, "x"))
        labels.append((k, int(good), "label text"))
    return rows, labels


def test_quality_ranks_held_out_rows(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(900, None, ""), (901, "", ""), (None, "fine words here", "")], DOCS)
    model = ql.fit_quality(docs, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, text string"))
    found = ql.score_quality(docs, model).collect()
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 for r in found)
    truth = {k: y for k, y, _ in labels}
    held = [r for r in found if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id in truth]
    assert np.mean([(r.score >= ql.CUT_SCORE) == truth[r.doc_id] for r in held]) > 0.95


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert ql.score_quality(docs, ql.fit_quality(docs, none)).first().score > ql.CUT_SCORE
    empty = spark.createDataFrame([], DOCS)
    assert ql.score_quality(empty, ql.fit_quality(empty, none)).count() == 0
    assert ql.text_features(pa.array([None, ""])).sum() == 0


def brute_tiles(item, doc, least):
    """Greedy string tiling, letter by letter."""
    a, b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in a and j + k not in b:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        a.update(range(best[0], best[0] + best[2]))
        b.update(range(best[1], best[1] + best[2]))
        out.append(best)


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        item, doc = rng.integers(0, 3, rng.integers(3, 16)), rng.integers(0, 3, rng.integers(3, 30))
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if (item[i : i + 3] == doc[j : j + 3]).all()]
        i, j = (np.array(x, int) for x in (zip(*seeds) if seeds else ((), ())))
        got = dc.tile(item, doc, (i, j), 3) if seeds else []
        want = brute_tiles(item.tolist(), doc.tolist(), 3)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in want)


def test_decontamination_catches_reordered_items(spark):
    item = [f"q{k}" for k in range(24)]
    texts = [
        (1, "before " + " ".join(item) + " after"), (2, " ".join(item[12:]) + " between " + " ".join(item[:12]).upper()), (3, " ".join(item[:6]) + " only a part"),
        (4, "clean text of some words that holds nothing"), (5, None), (6, ""), (None, " ".join(item)), (1, " ".join(item)), (7, "w " * 30_000 + ", ".join(item)),
    ]
    docs = spark.createDataFrame([(*x, "s") for x in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item), 0), (11, "too short", 0), (12, None, 0), (None, " ".join(item), 0)], "item_id long, text string, doc_id int")
    for block_bytes in (dc.BLOCK_BYTES, 8):
        kept = dc.decontaminate(docs, bench, block_bytes=block_bytes).collect()
        assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "5", "6"]
    tiled = dc.with_tilings(docs, bench).where("doc_id = 2").first().tilings
    assert [(t.item_id, t.item_words, t.covered, len(t.tiles)) for t in tiled] == [(10, 24, 24, 2)]
    assert dc.decontaminate(docs.limit(0), bench).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_license_lines(spark):
    docs = spark.createDataFrame([
        (1, "Intro text here\nreleased under the mit LICENSE\nmore", ""), (2, "This work is licensed under the GNU General Public License, version 2.", ""),
        (3, None, ""), (4, "", ""), (5, "license", ""), (None, "All rights reserved.", ""), (6, "All rights reserved." + " and more words" * 30, ""),
    ], "doc_id long, text string, license_id string")
    found = sorted((str(r.doc_id), r.line_no, r.license_id, round(r.dice, 3), r.line) for r in lc.license_scan(docs).collect())
    assert found == [
        ("1", 1, "MIT", 1.0, "released under the mit LICENSE"), ("2", 0, "GPL-2.0", 1.0, "This work is licensed under the GNU General Public License, version 2."),
        ("None", 0, "all-rights-reserved", 1.0, "All rights reserved."),
    ]
    assert lc.license_scan(docs.limit(0)).count() == 0


def test_license_passages(spark):
    full = {r.license_id: r.text for r in lc.full_texts(spark).collect()}
    wrapped = "\n".join(full["MIT"].split(". "))
    docs = spark.createDataFrame([
        (1, "x = 1\n" + wrapped + "\ny = 2"), (2, "# Copyright 2020 X. All rights reserved."),
        (3, '// Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'),
        (4, "/* This work is licensed under the GNU General\n * Public License, version 2. */"), (5, full["BSD-2-Clause"]), (6, full["BSD-3-Clause"]),
        (7, "a\nreleased under the mit LICENSE today\nb"), (8, "All rights reserved, and all\nrights reserved."), (9, "Licensed\nunder\nCC\nBY\n4.0"), (10, "nothing of the kind"), (None, None),
        (11, full["Apache-2.0"]),
    ], "doc_id long, text string")
    found = sorted((r.doc_id, r.line_no, r.license_id) for r in lc.license_scan(docs, passages=True).collect())
    assert found == [
        (1, 1, "MIT"), (2, 0, "all-rights-reserved"), (3, 0, "Apache-2.0"), (4, 0, "GPL-2.0"), (5, 0, "BSD-2-Clause"), (6, 0, "BSD-3-Clause"), (7, 1, "MIT"),
        (8, 0, "all-rights-reserved"), (8, 0, "all-rights-reserved"), (9, 0, "CC-BY-4.0"), (11, 1, "Apache-2.0"),
    ]


def test_license_passages_brute_force(spark):
    import random

    pick = random.Random(3)
    templates = [("A", "a b c d e"), ("B", "c d e f g h a"), ("C", "b a")]
    texts = [" ".join(pick.choice("abcdefghxy") if pick.random() < 0.5 else pick.choice([t for _, t in templates]) for _ in range(12)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = lambda w: {p for p in zip(w, w[1:])}
    found = {}
    for r in lc.license_scan(docs, spark.createDataFrame(templates, "license_id string, text string"), passages=True).collect():
        found.setdefault(r.doc_id, []).append((r.license_id, r.line, r.dice))
    for number, body in enumerate(texts):
        w, spans = body.split(), []
        for k, (name, template) in enumerate(templates):
            t = template.split()
            for x in range(len(w)):
                ends = []
                for y in range(x + 1, min(len(w), x + 1 + int((len(t) - 1) * 1.5))):
                    g, h = grams(w[x : y + 1]), grams(t)
                    if (w[x], w[x + 1]) in h and (w[y - 1], w[y]) in h and 2 * len(g & h) / (len(g) + len(h)) >= 0.8:
                        ends.append((-2 * len(g & h) / (len(g) + len(h)), y, len(g & h)))
                if ends:
                    dice, y, both = min(ends)
                    spans.append((both * dice, x, y, dice, k))
        want, taken = [], set()
        for _, x, y, dice, k in sorted(spans):
            if not taken & set(range(x, y + 1)):
                taken |= set(range(x, y + 1))
                want.append((templates[k][0], " ".join(w[x : y + 1]), -dice))
        assert sorted(found.get(number, [])) == sorted(want)


def test_mixing_meets_targets(spark):
    rows = [(k, " ".join(["der die das"] if k % 4 == 0 else ["the of and"]) + f" extra{k % 7}" * (k % 9 + 1), "r") for k in range(200)]
    docs = spark.createDataFrame(rows + [(None, "the of and", ""), (500, None, ""), (501, "", ""), rows[0]], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(k, "de" if k % 4 == 0 else "en") for k in range(0, 200, 3)] + [(None, "en"), (7, None)], "doc_id long, domain string")
    mixture = mx.mix_to_targets(docs, labels, {"de": 0.5, "en": 0.5})
    found = mixture.rated(docs).collect()
    assert len(found) == len(rows) + 4 and all(r.rate >= 0 for r in found)
    totals = [sum(r.rate * r.n_tokens * r.posterior[d] for r in found) for d in (0, 1)]
    assert abs(totals[0] - totals[1]) < 1e-3 * sum(totals)
    assert abs(sum(totals) - sum(r.n_tokens for r in found)) < 1e-3 * sum(totals)
    assert all(max(r.posterior) > 0.9 for r in found if r.n_tokens)
    plan = mixture.rated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_equals_plain_steps(spark):
    import math

    import xxhash

    rng = np.random.default_rng(8)
    lexicon = {"x": [f"a{k}" for k in range(40)], "y": [f"b{k}" for k in range(40)], "z": [f"a{k}" for k in range(20)] + [f"b{k}" for k in range(20)]}
    rows = [(k, " ".join(rng.choice(lexicon["xyz"[k % 3]], rng.integers(1, 30)))) for k in range(150)]
    labels = [(k, "xyz"[k % 3]) for k in range(0, 150, 2)]
    docs, places = spark.createDataFrame(rows, "doc_id long, text string"), mx.PLACES
    mixture = mx.mix_to_targets(docs, spark.createDataFrame(labels, "doc_id long, domain string"), {"x": 0.5, "y": 0.3, "z": 0.2})

    def held(text):
        signed = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()}
        return {(h - (1 << 64) * (h >> 63)) % places for h in signed.values()}

    texts, counts = dict(rows), np.full((3, places), 0.5)
    for k, d in labels:
        counts["xyz".index(d), list(held(texts[k]))] += 1
    logs = np.round(np.log(counts / counts.sum(1, keepdims=True)), 4)
    found = {r.doc_id: r for r in mixture.rated(docs).collect()}
    posterior = np.zeros((150, 3))
    for k, text in rows:
        score = np.array([math.log(1 / 3) + logs[d, list(held(text))].sum() for d in range(3)])
        posterior[k] = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert np.allclose(found[k].posterior, posterior[k], atol=1e-9) and found[k].n_tokens == len(text.split())
    tokens, rate = np.array([len(t.split()) for _, t in rows]), np.array([found[k].rate for k, _ in rows])
    totals = (posterior * (tokens * rate)[:, None]).sum(0)
    assert (rate >= 0).all() and mixture.gap <= mx.GAP
    assert np.allclose(totals / tokens.sum(), [0.5, 0.3, 0.2], atol=1e-6)


def test_short_benchmark_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "The capital: Paris, France."), (2, "capital is paris france, of course"), (3, "capital is paris"), (4, None), (5, "is capital paris france")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "capital is paris france"), (2, "..."), (3, None)], "item_id long, text string")
    found = {r.doc_id: r.tilings for r in dc.with_tilings(docs, items, block_bytes=1).collect()}
    assert {k for k, v in found.items() if v} == {2} and found[2][0].covered == 4
    assert sorted(r.doc_id for r in dc.decontaminate(docs, items).collect()) == [1, 3, 4, 5]


def test_mixing_reaches_corners_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "a b" if k % 2 else "c d", 0) for k in range(20)], "doc_id long, text string, n_tokens int")
    labels = spark.createDataFrame([(k, "x" if k % 2 else "y") for k in range(20)], "doc_id long, domain string")
    rates = {r.doc_id: r.rate for r in mx.mix_to_targets(docs, labels, {"x": 1.0, "y": 0.0}).rated(docs).collect()}
    assert all(rates[k] < 1e-2 for k in rates if k % 2 == 0) and all(rates[k] > 1.9 for k in rates if k % 2)
    assert mx.mix_to_targets(docs.limit(0), labels, {"x": 1.0}).rated(docs.limit(0)).count() == 0
    assert {r.rate for r in mx.mix_to_targets(docs, labels.limit(0), {"x": 1.0}).rated(docs).collect()} == {1.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav><div class="ad">Buy now, cheap, today, only</div>
<div id="wrap"><div class="post"><h2>Head</h2><p>First, with <b>bold and <i>more</b>&amp; signs,
 over   lines.<br>Next<p>Second paragraph, of some length, with commas, and so on.<ul><li>One<li>Two</ul></div>
<div id="comments"><p>Nice post, thank you, really, so good, I liked all of it very much, bye</p></div></div>
<aside><p>Aside, aside, aside</p></aside><div class="cookie-banner"><p>We use cookies, many, of them</p></div><form><p>Subscribe</p></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert hx.main_text(PAGE) == "Head\n\nFirst, with bold and more& signs, over lines. Next\n\nSecond paragraph, of some length, with commas, and so on.\n\nOne\n\nTwo"
    assert hx.main_text(None) == hx.main_text("") == hx.main_text("<html><body></body></html>") == hx.main_text("<nav><p>menu</p></nav>") == ""
    assert hx.main_text("<article><p>x</p></article>") == "x"
    assert hx.main_text("<p>a &lt;b&gt; < c</p>") == "a <b> < c"
    assert hx.main_text("<div><p>unclosed <a href='x") != ""
    long = "<article>" + "<p>word, word</p>" * 20_000 + "</article>"
    assert hx.main_text(long).count("\n\n") == 19_999


def test_extraction_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (2, None, None, None), (3, "u", "", "")], "page_id long, url string, html string, text string")
    found = hx.extract_main_text(pages).collect()
    assert sorted(r.page_id for r in found) == [1, 2, 2, 3] and all(r.n_chars == len(r.text) for r in found)
    assert hx.extract_main_text(pages.limit(0)).count() == 0


def test_marked_wrappers_keep_the_article():
    from civicspark.llm.html_extract import main_text

    body = "<p>First paragraph, long enough to count, with commas, and words.</p><p>Second paragraph, also long enough, with some more words in it.</p>"
    want = "First paragraph, long enough to count, with commas, and words."
    for wrapper in ("<div class='layout has-sidebar'>%s</div>", "<div class='content no-sidebar'>%s</div>", "<article class='post tags-x'>%s</article>", "<div id='page' class='nav-open'>%s</div>",
                    "<div class='widget'><article>%s</article></div>", "<div class='search'>%s</div>"):
        text = main_text("<html><body>" + wrapper % body + "<div class='ad'><p>Buy now, cheap.</p></div></body></html>")
        assert want in text and "Second" in text and "Buy now" not in text, wrapper
    teasers = "<div class='related'><article><p>Another story, in short.</p></article></div><div class='comments'><article class='comment'><p>I agree, fully.</p></article></div>"
    text = main_text("<html><body><article>" + body + "</article>" + teasers + "<div class='sidebar'><p>Aside, of the page.</p></div></body></html>")
    assert want in text and not any(x in text for x in ("Another", "agree", "Aside"))


def test_pages_keep_their_article_in_any_wrapper():
    body = "<h1>Head</h1>" + "".join(f"<p>Sentence {k}, of the article, with commas and words enough.</p>" for k in range(4))
    want = ["Head", *(f"Sentence {k}, of the article, with commas and words enough." for k in range(4))]
    for page in (
        f"<article class='post has-comments'>{body}</article>", f"<div class='layout sidebar-right'><article>{body}</article></div>",
        f"<form id='aspnetForm'><div class='nav'><a href='/'>Home</a></div><div>{body}</div></form>", f"<form><article>{body}</article></form>",
        f"<h1>Head</h1><div>{body[13:]}</div>", f"<main><div><h1>Head</h1></div><div class='entry'>{body[13:]}</div></main>",
    ):
        assert hx.main_text(f"<html><body>{page}<form><p>Subscribe, now, to all of our letters.</p><input></form></body></html>").split("\n\n") == want
    short = "<div>A short part.</div>".join(f"<div>{body[13:]}</div>" for _ in range(2))
    assert "A short part." in hx.main_text(f"<html><body><div>{short}</div></body></html>")


def test_deep_pages_take_time_in_proportion():
    import time

    began = time.process_time()
    for opening, closing in (("<div>", "</div>"), ("<div class='header'>", "</section>"), ("<div class='sidebar'><li>", "</p>"), ("<form>", "</form>"), ("<article>", "</aside>")):
        hx.main_text(opening * 30_000 + "<p>In the middle, far down.</p>" + closing * 30_000)
    assert time.process_time() - began < 20


LONG = "A long paragraph of the story, with commas, and clauses, that goes on for quite a while, so that it scores well, as stories do."
REFERENCES = "<h2>References</h2><ul>" + "".join(f'<li><a href="/{k}">Source {k}</a></li>' for k in range(4)) + "</ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{LONG}</p>{REFERENCES}</article>", [LONG, "References", *[f"Source {k}" for k in range(4)]]),
        (f'<article><p>{LONG}</p><p class="related">Related work is told here.</p></article>', [LONG, "Related work is told here."]),
        (f'<article><p>{LONG}</p><section id="search"><h2>Search</h2><p>How the search went on.</p></section></article>', [LONG, "Search", "How the search went on."]),
        (f"<body><div>A short lead.</div><div><p>{LONG}</p><p>{LONG}</p></div><div>A last word.</div></body>", ["A short lead.", LONG, LONG, "A last word."]),
        (f"<body><h1>Headline</h1><div>By Ann Lee</div><div><p>{LONG}</p><p>{LONG}</p></div></body>", ["Headline", "By Ann Lee", LONG, LONG]),
        # by structure these are none of the article
        (f'<article><p>{LONG}</p><div class="related"><a href="/1">One</a> <a href="/2">Two</a></div></article>', [LONG]),
        (f'<article><p>{LONG}</p><section id="search"><form><input>Find it</form> now</section></article>', [LONG]),
        (f'<article><p>{LONG}</p><div class="comments"><p>First, said a reader.</p></div><div class="ad"><p>Buy now.</p></div></article>', [LONG]),
        (f'<body><div><a href="/">Home</a> <a href="/n">News</a></div><div><p>{LONG}</p></div><div><a href="/p">Privacy</a></div></body>', [LONG]),
    ],
)
def test_nothing_of_an_article_is_lost(page, want):
    assert hx.main_text(f"<!DOCTYPE html><html><head><title>T</title></head>{page}</html>").split("\n\n") == want


class Plain(HTMLParser):
    """A second reader: the texts between block tags inside the article, but for dropped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.dropped, self.run, self.out = 0, 0, "", []

    def cut(self):
        if text := " ".join(self.run.split()):
            self.out.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in hx._BLOCKS or tag == "br":
            self.run += " " if tag == "br" else ""
            if tag != "br":
                self.cut()
        self.inside += tag == "article"
        self.dropped += tag in ("nav", "aside", "form", "footer", "header", "script", "style") or self.dropped and tag == "div" or ("class", "ad") in attrs

    def handle_endtag(self, tag):
        if tag in hx._BLOCKS:
            self.cut()
        self.inside -= tag == "article"
        self.dropped -= bool(self.dropped and tag in ("nav", "aside", "form", "footer", "header", "script", "style", "div"))

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.run += data


def test_pages_equal_a_second_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    compared = 0
    for r in pages:
        if r.html and r.html.count("<article") == 1 and "</article>" in r.html:
            reader = Plain()
            reader.feed(r.html)
            reader.close()
            reader.cut()
            assert hx.main_text(r.html).split("\n\n") == reader.out, r.page_id
            compared += 1
    assert compared > len(pages) / 2
