"""Main text of web pages: boosted trees over DOM nodes, decoded with the hierarchy.

A page is parsed into block elements and text blocks (white space between two block boundaries).  A node is wanted if
its subtree holds main text.  Boosted trees give every node the log odds of that from its subtree's size, text, link and
punctuation density, the words in its class, id and role and in those of its ancestors, depth and siblings.  Decoding
takes the likeliest labelling in which nothing below an unwanted node is wanted, so an ancestor and a descendant
cannot contradict each other; it is one pass over the nodes from the last to the first.

The trees are fitted on at most ``TRAIN_PAGES`` pages of any length (least hash of page_id; fewer if they exceed
``TRAIN_CHARS`` characters together, but at least one) and on
``VARIANTS`` rearrangements of each under other tags and names, with menus, sidebars, notices, forms, adverts and reader
comments around and inside.  In given pages text in article or main is main text, unless nearer to a menu, aside or form.
In a given page without such text the paragraphs of its densest element are main text, if they are most of its
paragraphs; else the page says nothing, and only its rearrangements are learnt from.  Every other page is learnt from twice, once with those elements under
other tags and names, so that the model does not rest on them.
The model is a few kilobytes and goes to the workers with the function.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import boosting

TRAIN_PAGES = 300
TRAIN_CHARS = 300 * 64_000
VARIANTS = 3
SEED = 11

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset(
    "script style noscript template head title svg iframe select textarea button object canvas audio video datalist".split()
)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp")}
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: An opening tag ends an open element of these kinds, looked for up to the nearest of the others.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Open elements that such a search passes at most, so that parsing is linear in depth.  Browsers nest no deeper, either.
MOST_BETWEEN = 512
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Kinds of tags, and of words in names (a word counts if it begins so).
TAG_KINDS = [
    {"#text"}, {"body", "html", "#root"}, {"div", "section"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"},
    {"li", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "legend", "input"}, {"article", "main"}, {"blockquote", "pre", "figure", "figcaption"}, {"address", "details", "dialog"},
]
NAME_KINDS = [
    "nav menu breadcrumb crumb tab toc pagination pager topbar toolbar skip",
    "header masthead banner logo brand hero",
    "foot copyright legal colophon",
    "side aside rail widget",
    "ad ads advert adsense advertisement promo sponsor dfp affiliate",
    "comment discuss disqus reply replies respond reader review feedback",
    "form login signin signup subscribe newsletter search contact register",
    "cookie consent notice alert gdpr popup modal overlay banner warning paywall",
    "share social related recommend popular trending more tag author byline bio meta",
    "article content post entry story main body text prose read blog news page",
]
_TAG_KIND = {tag: k for k, tags in enumerate(TAG_KINDS) for tag in tags}
_STEMS = [(stem, 1 << k) for k, stems in enumerate(NAME_KINDS) for stem in stems.split()]
_WORDS: dict[str, int] = {}


def _name_kinds(attributes: str) -> int:
    """A bit per kind of word in class, id and role."""
    if "=" not in attributes:
        return 0
    kinds = 0
    for found in _NAMED.finditer(attributes):
        for part in _PARTS.findall(found[1] or found[2] or found[3] or ""):
            word = part.lower()
            bits = _WORDS.get(word)
            if bits is None:
                bits = 0
                for stem, bit in _STEMS:
                    if word == stem or len(stem) > 3 and word.startswith(stem):
                        bits |= bit
                if len(_WORDS) < 50_000:
                    _WORDS[word] = bits
            kinds |= bits
    return kinds


class Page:
    """A page's nodes in the order in which they open; text blocks are leaves."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.names: list[int] = [0]
        self.text: list[str | None] = [None]
        self.linked: list[int] = [0]
        self._parse(source)

    def _add(self, tag: str, parent: int, names: int = 0, text: str | None = None, linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, open_tags = [0], ["#root"]  # open block elements
        n_open = Counter(open_tags)
        held: list[str] = []
        linked = at = 0
        link = False
        skipped = 0  # depth of open elements whose text is never shown

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self._add("#text", stack[-1], 0, text, min(linked, len(text)))
                held.clear()
            linked = 0

        def take(raw: str) -> None:
            nonlocal linked
            if skipped or not raw:
                return
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if link:
                linked += len(text)

        def close(to: int) -> None:
            """Close open elements down to a depth."""
            nonlocal skipped
            flush()
            for t in open_tags[to:]:
                skipped -= t in _SKIPPED
                n_open[t] -= 1
            del stack[to:], open_tags[to:]

        for token in _TOKEN.finditer(source):
            if token.start() < at:
                continue
            take(source[at : token.start()])
            at = token.end()
            tag = token[2] or token[5]
            if tag is None:
                continue
            tag, ending, attributes = tag.lower(), token[1] or token[4], token[3] or token[6] or ""
            if tag in _INLINE:
                if tag == "a":
                    link = not ending
                elif tag == "br":
                    held.append(" ")
                continue
            if ending:
                if n_open[tag]:
                    to = len(open_tags) - 1
                    while open_tags[to] != tag:  # what is passed is closed, so it is passed once
                        to -= 1
                    close(to)
                    if link and tag not in ("p", "li"):
                        link = False
                continue
            if open_tags[-1] == "head" and tag not in _IN_HEAD:
                close(len(open_tags) - 1)
            if open_tags[-1] == "p":
                close(len(open_tags) - 1)
            elif tag in _ENDS and any(n_open[t] for t in _ENDS[tag][0]):
                ended, barrier = _ENDS[tag]
                for depth in range(len(open_tags) - 1, max(0, len(open_tags) - 1 - MOST_BETWEEN), -1):
                    if open_tags[depth] in barrier:
                        break
                    if open_tags[depth] in ended:
                        close(depth)
                        break
            flush()
            if tag in _VOID:
                continue
            if tag in _RAW:
                found = _RAW[tag].search(source, at)
                if tag == "xmp":
                    take(source[at : found.start() if found else len(source)])
                at = found.end() if found else len(source)
                continue
            if attributes.endswith("/") and tag in ("svg", "path"):
                continue
            if tag in _SKIPPED or skipped:
                skipped += tag in _SKIPPED
                stack.append(stack[-1])
            else:
                stack.append(self._add(tag, stack[-1], _name_kinds(attributes)))
            open_tags.append(tag)
            n_open[tag] += 1
        take(source[at:])
        flush()


N_FEATURES = 14 + 2 * len(TAG_KINDS) + 2 * len(NAME_KINDS)


def features(page: Page) -> np.ndarray:
    """A row per node."""
    n = len(page.tag)
    parent = page.parent
    kind = [_TAG_KIND.get(t, 2) for t in page.tag]
    chars, words, marks, links, blocks, inner = ([0] * n for _ in range(6))
    depth, place, same, children = ([0] * n for _ in range(4))
    above_tags, above_names, before = [0] * n, [0] * n, [0] * n
    by_tag: dict[tuple[int, int], int] = {}
    seen = 0
    for i in range(n):
        up = parent[i]
        before[i] = seen
        if up >= 0:
            depth[i] = depth[up] + 1
            place[i] = children[up]
            children[up] += 1
            key = (up, kind[i])
            by_tag[key] = by_tag.get(key, 0) + 1
            above_tags[i] = above_tags[up] | 1 << kind[up]
            above_names[i] = above_names[up] | page.names[up]
        text = page.text[i]
        if text is not None:
            chars[i], words[i], links[i], blocks[i] = len(text), text.count(" ") + 1, page.linked[i], 1
            marks[i] = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            seen += len(text)
        else:
            inner[i] = 1
    for i in range(n - 1, 0, -1):
        up = parent[i]
        chars[up] += chars[i]
        words[up] += words[i]
        marks[up] += marks[i]
        links[up] += links[i]
        blocks[up] += blocks[i]
        inner[up] += inner[i]
    for i in range(1, n):
        same[i] = by_tag[parent[i], kind[i]]
    c, w, m, l, b, e = (np.array(x, np.float64) for x in (chars, words, marks, links, blocks, inner))
    total = max(c[0], 1.0)
    up = np.maximum(np.array(parent), 0)
    siblings = np.array(children, np.float64)[up]
    columns = [
        np.log1p(c), np.log1p(w), w / np.maximum(b, 1), l / np.maximum(c, 1), m / np.maximum(w, 1), c / (e + b), np.log1p(b), np.log1p(e),
        np.array(depth, np.float64), np.array(place) / np.maximum(siblings, 1), np.log1p(siblings), np.array(same) / np.maximum(siblings, 1),
        c / total, np.array(before) / total,
    ]

    def bits(masks, width):
        return (np.array(masks, np.int64)[:, None] >> np.arange(width)) & 1

    tags = np.array([1 << k for k in kind], np.int64)
    return np.column_stack(
        [*columns, bits(tags, len(TAG_KINDS)), bits(above_tags, len(TAG_KINDS)), bits(page.names, len(NAME_KINDS)), bits(above_names, len(NAME_KINDS))]
    )


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The likeliest labels such that nothing below an unwanted node is wanted."""
    yes = (-np.logaddexp(0, -odds)).tolist()
    no = (-np.logaddexp(0, odds)).tolist()
    n = len(parent)
    best = [0.0] * n  # of a subtree, its root wanted
    none = [0.0] * n  # all unwanted
    for i in range(n - 1, -1, -1):
        best[i] += yes[i]
        none[i] += no[i]
        if i:
            best[parent[i]] += max(best[i], none[i])
            none[parent[i]] += none[i]
    wanted = [False] * n
    for i in range(n):
        wanted[i] = best[i] > none[i] and (i == 0 or wanted[parent[i]])
    return wanted


_MARK = ""
_CONTENT, _ASIDE = {"article", "main"}, {"nav", "aside", "footer", "form", "header"}


def _labels(page: Page) -> np.ndarray:
    """Wanted nodes of a training page: marked text if there is any, else text in article or main."""
    n = len(page.tag)
    wanted = [False] * n
    marked = any(t is not None and _MARK in t for t in page.text)
    for i in range(n - 1, 0, -1):
        if page.text[i] is not None:
            if marked:
                wanted[i] = _MARK in page.text[i]
                page.text[i] = page.text[i].replace(_MARK, "")
            else:
                up = page.parent[i]
                while up > 0 and page.tag[up] not in _CONTENT and page.tag[up] not in _ASIDE:
                    up = page.parent[up]
                wanted[i] = page.tag[up] in _CONTENT
        wanted[page.parent[i]] |= wanted[i]
    return np.array(wanted)


def _variant(main: list[str], spare: list[str], rng: random.Random) -> str:
    """A page with the given main blocks under other tags and names, and with what else pages have."""
    pick, some = rng.choice, lambda p: rng.random() < p

    def words(n: int) -> str:
        out: list[str] = []
        while len(out) < n:
            out += pick(spare).split()
        at = rng.randrange(max(1, len(out) - n))
        return html.escape(" ".join(out[at : at + n]))

    def name(*choices: str) -> str:
        if some(0.25):
            return ""
        own = pick(choices)
        return f' {pick(["class", "id"])}="{pick([own, own, own + "-" + pick(["wrap", "box", "1", "outer", "list"]), "x " + own])}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randrange(1, 5))}</a></li>' for i in range(n)) + "</ul>"

    def box(tags: str, inside: str, *names: str) -> str:
        tag = pick(tags.split())
        return f"<{tag}{name(*names) if tag not in ('nav', 'aside', 'footer', 'form') or some(0.4) else ''}>{inside}</{tag}>"

    def named(tag: str, inside: str, *names: str) -> str:
        return f'<{tag} {pick(["class", "id"])}="{pick(names)}{pick(["", "", "-1", "-area", " box"])}">{inside}</{tag}>'

    def prose(n: int) -> str:
        return "".join(f"<p>{words(rng.randrange(8, 60))}</p>" for _ in range(n))

    advert = lambda: named(pick(["div", "aside", "section"]), pick([words(rng.randrange(2, 25)), prose(1)]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot")
    form = lambda: f"<form{name('newsletter', 'subscribe', 'search', 'login')}><label>{words(2)}</label><input><p>{words(rng.randrange(3, 15))}</p><button>{words(1)}</button></form>"
    notice = lambda: named("div", pick([words(rng.randrange(4, 30)), prose(1)]), "cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup")
    said = lambda: pick(["<div class=comment>{}</div>", "<li>{}</li>", "<article class=comment>{}</article>"]).format(f"<b>{words(1)}</b>" + prose(rng.randrange(1, 3)))
    comments = lambda: named(pick(["div", "section"]), f"<h2>{words(1)}</h2>" + "".join(said() for _ in range(rng.randrange(1, 6))), "comments", "comment-list", "discussion", "reader-comments", "responses", "disqus_thread")
    side = lambda: box("aside div div", f"<h3>{words(2)}</h3>" + pick([links(rng.randrange(2, 9)), prose(1), links(4) + prose(1)]), "sidebar", "side", "widget", "related", "rail", "popular")
    share = lambda: named("div", links(rng.randrange(2, 5)), "share", "social", "related", "tags", "author-bio")
    inside = []
    for i, text in enumerate(main):
        if some(0.1):  # main text has blocks of a word or two, too
            text = " ".join(text.split()[: rng.randrange(1, 4)])
        block = html.escape(_MARK + text)
        tag = "h1" if not i and some(0.7) else pick(["p"] * 12 + ["h2", "blockquote", "li", "div"])
        inside.append(f"<ul><li>{block}</li></ul>" if tag == "li" else f"<p>{block}" if tag == "p" and some(0.1) else f"<{tag}>{block}</{tag}>")
        if some(0.04):
            inside.append(pick([advert, share, form, side])())
    tail = (comments() if some(0.35) else "") + (share() if some(0.2) else "")
    inner = some(0.5)
    holder = pick(["article", "main", "div", "section", "div"])
    body = "".join(inside) + (tail if inner else "")
    if some(0.3):
        body = f"<div{name('text', 'body', 'entry-content')}>{body}</div>"
    names = ("content", "article-body", "post", "entry-content", "story", "main-content", "post-content", "text")
    if not some(0.15):  # else the blocks stand in the page's body
        body = f"<{holder}{name(*names)}>{body}</{holder}>"
    if some(0.3):
        body = f"<div{name('container', 'wrapper', 'page', 'layout')}>{body}{side() if some(0.5) else ''}</div>"
    top = (notice() if some(0.3) else "") + (f"<header{name('header', 'masthead')}><div>{words(2)}</div>{links(3) if some(0.4) else f'<p>{words(6)}</p>'}</header>" if some(0.5) else "")
    top += box("nav div nav", links(rng.randrange(3, 9)), "nav", "menu", "navbar", "topnav") if some(0.8) else ""
    top += (advert() if some(0.5) else "") + (side() if some(0.25) else "")
    end = ("" if inner else tail) + (side() if some(0.4) else "") + (form() if some(0.3) else "") + (advert() if some(0.2) else "") + (notice() if some(0.15) else "")
    end += box("footer footer div", pick([f"&copy; {words(rng.randrange(3, 20))}", links(4) + f"<p>&copy; {words(6)}</p>", prose(1)]), "footer", "copyright", "site-footer")
    return f"<html><head><title>{words(4)}</title></head><body>{top}{body}{end}</body></html>"


_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}


def _densest(page: Page) -> list[int]:
    """The paragraphs and headings of the element that has most of them as children, by characters without links.

    None if that element holds less than half of what stands in paragraphs: then density does not tell.
    """
    weight: Counter[int] = Counter()
    blocks: dict[int, list[int]] = {}
    for i, (text, linked, up) in enumerate(zip(page.text, page.linked, page.parent)):
        if text and page.tag[up] in _PROSE and 2 * linked < len(text):
            holder = page.parent[up]
            weight[holder] += len(text) - linked
            blocks.setdefault(holder, []).append(i)
    if not weight:
        return []
    holder, most = weight.most_common(1)[0]
    return blocks[holder] if 2 * most >= weight.total() else []


def _seeded(page: Page) -> np.ndarray:
    """Labels of a page without telling tags, from density."""
    wanted = np.zeros(len(page.tag), bool)
    for i in _densest(page):
        while i >= 0 and not wanted[i]:
            wanted[i], i = True, page.parent[i]
    return wanted


def _retagged(page: Page, rng: random.Random) -> Page:
    """A copy of a parsed page whose article and main elements are others, with and without telling names."""
    copy = Page("")
    tag, name = rng.choice(["div", "section", "div"]), rng.choice(["", "", ' class="story"', ' id="content"', ' class="c1"'])
    copy.tag = [tag if t in _CONTENT else t for t in page.tag]
    copy.names = [_name_kinds(name) if t in _CONTENT else n for t, n in zip(page.tag, page.names)]
    copy.parent, copy.text, copy.linked = page.parent, page.text, page.linked
    return copy


def training_rows(sources: list[str], variants: int = VARIANTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the given pages and of their rearrangements."""
    rng = random.Random(seed)
    given = [Page(s) for s in sources]
    labels = [_labels(p) for p in given]
    texts = [[t for t in p.text if t] for p in given]
    spare = [t for own in texts for t in own if len(t) > 20] or ["some words, as there are none here."]
    pages, wanted = [], []
    for i, page in enumerate(given):
        if labels[i].any():
            # The same page under other tags, too: a model that knew article and main alone would find nothing elsewhere.
            pages.append(_retagged(page, rng))
            wanted.append(labels[i])
        else:
            labels[i] = _seeded(page)
        if labels[i].any():  # else nothing says which text is the main one
            pages.append(page)
            wanted.append(labels[i])
    for page, known, own in zip(given, labels, texts):
        main = [t for t, w in zip(page.text, known) if t and w] or [t for t in own if t.count(" ") > 15] or [rng.choice(spare)]
        for _ in range(variants):
            # Of one page's main text a random stretch, so that short and long articles occur.
            begin = rng.randrange(len(main)) if rng.random() < 0.3 else 0
            other = Page(_variant(main[begin : begin + rng.randrange(1, 40)], spare, rng))
            pages.append(other)
            wanted.append(_labels(other))
    labels = wanted
    return np.concatenate([features(p) for p in pages]), np.concatenate(labels).astype(np.float64)


def fit_pages(pages: DataFrame, most: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> boosting.Trees | None:
    """Fit on a bounded sample of the pages; none if there are no pages with html.

    Pages are taken by hash until there are ``most`` or the next would exceed ``chars`` characters together; the first is
    taken whatever its length.  Lengths are looked at before any html is collected, and only about four times the sample
    leaves the scan: a task offers no page beyond that share of all hashes, unless ids are too alike to fill the sample.
    """
    space = 1 << 40
    key = F.struct(F.pmod(F.xxhash64("page_id"), F.lit(space)).alias("rank"), F.xxhash64("html").alias("own"))
    given = pages.filter("html IS NOT NULL").select("html", key.alias("_key"))
    count = given.count()
    share = int(space * min(1.0, 4 * most / max(1, count)))
    sizes = given.select("_key", F.length("html").alias("_size"))
    found = sizes.filter(F.col("_key.rank") < share).orderBy("_key").limit(most).collect()
    if len(found) < min(most, count):
        found = sizes.orderBy("_key").limit(most).collect()
    if not found:
        return None
    taken = max(1, int((np.cumsum([r["_size"] for r in found]) <= chars).sum()))
    last = found[taken - 1]["_key"]
    near = given.filter(F.col("_key") <= F.struct(F.lit(last["rank"]).alias("rank"), F.lit(last["own"]).alias("own")))
    return boosting.fit(*training_rows([r.html for r in near.orderBy("_key").limit(taken).collect()]))


def main_blocks(source: str, model: boosting.Trees) -> list[str]:
    page = Page(source)
    wanted = decode(page.parent, model.scores(features(page)))
    return [t for t, w in zip(page.text, wanted) if t and w]


def extract(pages: DataFrame, model: boosting.Trees | None = None) -> DataFrame:
    """page_id, url, text (wanted blocks joined by a newline, empty if none), n_chars: one row per row of ``pages``.

    A null html counts as empty.  The model is fitted on ``pages`` if none is given.  Pages of any length are parsed
    whole; damaged markup ends open elements as browsers do, in the main.  Other columns are not read.  Html without a
    model is an error, not an empty text.
    """
    model = model or fit_pages(pages)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").to_pylist()
            if not model and any(sources):
                raise ValueError("no page to fit the model on, but pages to extract from")
            parsed = [Page(s or "") for s in sources]
            texts: list[str] = []
            for begin in range(0, len(parsed), 256):
                group = parsed[begin : begin + 256]
                odds = model.scores(np.concatenate([features(p) for p in group])) if model else np.zeros(sum(len(p.tag) for p in group))
                parts = np.split(odds, np.cumsum([len(p.tag) for p in group])[:-1])
                for page, own in zip(group, parts):
                    texts.append("\n".join(t for t, w in zip(page.text, decode(page.parent, own)) if t and w))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
