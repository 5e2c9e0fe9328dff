"""Main text against known articles: given pages, rearranged pages that training has not seen, damaged markup."""

import collections
import html
import itertools
import random
import re

import numpy as np
import pytest

from telemill.llm import boosting, html_main

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_main.fit_pages(pages, 100)


def article(source):
    """The blocks of the given pages' articles, whose markup is simple."""
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return [b for b in blocks if b]


def test_given_pages(pages, model):
    rows = html_main.extract(pages, model).collect()
    sources = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert len(rows) == len(sources)
    right = sum(r.text == "\n".join(article(sources[r.page_id][1])) for r in rows)
    assert right >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) and r.url == sources[r.page_id][0] for r in rows)


def test_unseen_arrangements(pages, model):
    sources = [r.html for r in pages.orderBy("page_id").collect()][100:]
    rng = random.Random(77)
    spare = [b for s in sources[:40] for b in article(s) if len(b) > 20]
    right = wanted = found = 0
    for source in sources:
        main = article(source)
        shown = html_main._variant(main, spare, rng)
        want = collections.Counter(t.replace(html_main._MARK, "") for t in html_main.Page(shown).text if t and html_main._MARK in t)
        got = collections.Counter(html_main.main_blocks(shown.replace(html_main._MARK, ""), model))
        right += sum((want & got).values())
        wanted, found = wanted + sum(want.values()), found + sum(got.values())
    assert right >= 0.97 * found and right >= 0.97 * wanted


def test_what_surrounds_an_article_is_left_out(model):
    long = " ".join(f"Sentence number {i} of the article, which goes on for a while." for i in range(6))
    source = f"""<!doctype html><title>T</title><script>var a = "<p>no</p>";</script><style>p {{}}</style>
    <header class="site-header"><a href="/">Site</a></header><nav class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
    <div id="cookie-notice"><p>We use cookies.</p></div>
    <div class="post-content"><h1>Title &amp; more</h1><p>{long}<p>Fish &lt;b&gt; caf&eacute;\n\n &#8364; <b>bold</b>ly, <i>so</i> to&nbsp;say.
    <!-- <p>hidden</p> --><div class="advertisement"><p>Buy now.</p></div><p>{long}</p>
    <form class=newsletter><p>Subscribe</p><input name=x></form></div>
    <div class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with that, not at all, as I said.</p></div></div>
    <aside class="sidebar"><ul><li><a href=3>More</a></ul></aside><footer><p>&copy; Site</p></footer>"""
    assert html_main.main_blocks(source, model) == ["Title & more", long, "Fish <b> café € boldly, so to say.", long]


def test_odd_pages(spark, model):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p><b>" * 3000), (5, "u", "<a href='" * 500), (None, "u", "</p></div>"),
        (6, "u", "<article><p>" + "Many words, in one block. " * 40_000 + "</article>"), (6, "u", "<script>never closed <p>x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [(r.page_id, r.text) for r in html_main.extract(pages, model).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert texts[1] == texts[2] == "" and texts[None] == "" and (6, "") in got
    assert len(max(t for _, t in got if t)) > 900_000
    empty = pages.filter("page_id = 77")
    assert html_main.extract(empty).count() == 0


def long_page(i, blocks=700):
    menu = "".join(f"<li><a href=/{k}>Go {k}</a></li>" for k in range(8))
    main = "".join(f"<p>Long page {i}, block {k}: a sentence of the article, which goes on for quite a while, and then ends.</p>" for k in range(blocks))
    return f"<html><body><nav class=menu><ul>{menu}</ul></nav><article><h1>Title {i}</h1>{main}</article><footer><p>&copy; Site</p></footer></body></html>"


def test_a_table_of_long_pages_only(spark):
    rows = [(i, "u", long_page(i)) for i in range(3)] + [(3, "u", None)]
    assert min(len(s) for _, _, s in rows[:3]) > 64_000
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert texts.pop(3) == ""
    assert all(texts[i] == "\n".join(article(rows[i][2])) for i in texts) and len(texts) == 3


def test_training_sample_is_bounded_by_fewer_pages_not_shorter_ones(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_main, "training_rows", lambda sources: (seen.append(sources), (np.eye(4), np.array([0.0, 1, 0, 1])))[1])
    rows = [(i, long_page(i, 5 + 300 * (i % 2))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    html_main.fit_pages(pages, 20)
    html_main.fit_pages(pages, 20, 200_000)
    html_main.fit_pages(pages, 20, 1)
    html_main.fit_pages(pages.selectExpr("7 AS page_id", "html"), 4)
    assert [len(s) for s in seen][::2] == [20, 1] and len(seen[3]) == 4
    assert seen[1] == seen[0][: len(seen[1])] and sum(map(len, seen[1])) <= 200_000 < sum(map(len, seen[0][: len(seen[1]) + 1]))
    assert html_main.fit_pages(pages.filter("page_id < 0")) is None


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        best = max(
            (labels for labels in itertools.product([False, True], repeat=n) if all(not labels[i] or labels[parent[i]] for i in range(1, n))),
            key=lambda labels: sum(-np.logaddexp(0, -o if y else o) for y, o in zip(labels, odds)),
        )
        assert html_main.decode(parent, odds) == list(best)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 4))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 2] > 0.3)).astype(float)
    model = boosting.fit(rows[:2000], labels[:2000])
    assert ((model.scores(rows[2000:]) > 0) == (labels[2000:] > 0)).mean() > 0.95


LAYOUTS = {
    "story": ('<div class="story">', "</div>"), "div": ("<div>", "</div>"), "section": ('<section id="text">', "</section>"),
    "main": ("<main>", "</main>"), "body": ("", ""), "article": ("<article>", "</article>"),
}


@pytest.mark.parametrize("layout", ["div", "body", "section", "mixed", "tenth"])
def test_pages_without_telling_tags(pages, layout):
    """Fitted and extracted on pages whose articles stand under other tags, in all or some of the pages."""
    sources = [r.html for r in pages.orderBy("page_id").collect()][:160]
    kinds = {"mixed": list(LAYOUTS), "tenth": ["div"] + ["article"] * 9}.get(layout, [layout])
    shown = []
    for i, source in enumerate(sources):
        begin, end = LAYOUTS[kinds[i % len(kinds)]]
        shown.append(source.replace("<article>", begin).replace("</article>", end))
    model = boosting.fit(*html_main.training_rows(shown[:80]))
    total = missed = more = 0
    for source, page in zip(sources, shown):
        want, got = collections.Counter(article(source)), collections.Counter(html_main.main_blocks(page, model))
        assert got
        total += sum(len(t) * n for t, n in want.items())
        missed += sum(len(t) * n for t, n in (want - got).items())
        more += sum(len(t) * n for t, n in (got - want).items())
    assert missed <= 0.05 * total and more <= 0.05 * total


def test_parsing_is_linear_in_depth():
    """A quadratic parser would take minutes."""
    for source in ("<div>" * 200_000 + "x" + "</div>" * 200_000, "<div><li>" * 100_000 + "x" + "</p>" * 100_000, "<ul>" + "<div>" * 100_000 + "<li>x" * 100_000):
        assert any(t and "x" in t for t in html_main.Page(source).text)
