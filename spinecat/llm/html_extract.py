"""Main text of web pages by boosted trees over DOM nodes, decoded top down.

A page is read into a tree of its block elements. Each node gets features of its own (tag, attribute
tokens, depth, place among its siblings), of its subtree (text, link and sentence density, parts)
and of its ancestors. Boosted trees give each node the probability that it belongs to the article.
Decoding picks the most likely labels under one rule: below a rejected node nothing is kept. It is
a sum over the tree, best(node) = max(reject all below, keep the node + best of its children), so
an ancestor and a descendant never contradict each other.

The text is that of the kept nodes: character references decoded, white space inside a block one
space, trimmed, blocks in page order joined by a line feed. Scripts, styles, the head and other
elements without visible text are never read. The head ends, where its end tag is left out, at the
first tag or text that cannot stand in it. A self-closing tag opens no unseen element, and one that
is never closed ends with the block it stands in.

The trees are fitted on the driver from about ``SAMPLE`` pages, chosen by hash: as they are where
they mark their article, and with their paragraphs and their other texts set anew in
made-up layouts, which know the truth by construction.

A null or empty page, and one without an article, gives the empty text. Repeated ids are judged row
by row. An empty table gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import random
import re
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c
from spinecat.llm import trees

SAMPLE = 200
#: Longer pages are read like others, but not trained on.
SAMPLE_CHARS = 200_000
LAYOUTS = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title iframe object svg math canvas audio video select datalist".split())
#: Elements that may stand in the head; any other ends it.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template head".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup search "
    "dialog center menu legend ins".split()
)
#: An element that a new one of the same group ends, and the elements that shield it.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}

TAG_GROUPS = (
    ("article", "main"), ("p", "blockquote", "pre", "figure", "figcaption"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer", "address"), ("aside", "dialog"),
    ("form", "fieldset", "legend", "search"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    ("section", "div", "center", "details", "summary"), ("html", "body"), ("ins",),
)
GROUP_OF = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group}

#: Attribute tokens (of class, id, role and aria-label) by what they tell.
TOKENS = (
    "article|content|main|story|entry|post|body|text|prose",
    "nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|toc|tabs|pagination|pager|skip",
    "header|masthead|banner|topbar|top|logo|hero|contentinfo|footer|foot|copyright|legal|bottom",
    "sidebar|aside|side|rail|widget|related|recommended|more|popular|trending|complementary|tags",
    "ad|ads|advert|advertisement|adsbygoogle|sponsor|sponsored|promo|promotion|banner|teaser",
    "notice|cookie|cookies|consent|gdpr|alert|warning|modal|popup|overlay|newsletter|subscribe|signup|dialog",
    "comment|comments|commentlist|reply|replies|discussion|respond|disqus|reader|feedback",
    "form|search|login|share|social|sharing|follow|hidden|buttons|toolbar|print",
)
TOKEN_GROUP: dict[str, list[int]] = {}
for _k, _group in enumerate(TOKENS):
    for _word in _group.split("|"):
        TOKEN_GROUP.setdefault(_word, []).append(_k)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SENTENCE = re.compile(r"[.!?,;:]")


class Page(HTMLParser):
    """Block elements of a page in document order, and the blocks of text they hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens, self.gold, self.hidden = [], [], [], [], []
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.stack: list[tuple[str, int]] = []  # tag, node (-1: inline)
        self.node, self.links, self.inputs = -1, 0, []
        self.unseen: list[str] = []  # the unseen element and the unseen and block elements open in it
        self.buffer: list[str] = []
        self.linked = 0
        self._open("html", [])

    def _open(self, tag: str, attrs) -> None:
        self._flush()
        found, gold, hidden = [], None, False
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                found.extend(k for w in SPLIT.split(CAMEL.sub(" ", value).lower()) for k in TOKEN_GROUP.get(w, ()))
            elif name == "data-gold":
                gold = value
            elif name == "hidden" or (name == "style" and value and "none" in value and "display" in value):
                hidden = True
        self.parent.append(self.node)
        self.tag.append(tag)
        self.tokens.append(found)
        self.gold.append(gold)
        self.hidden.append(hidden)
        self.inputs.append(0)
        self.node = len(self.tag) - 1
        self.stack.append((tag, self.node))

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((self.node, text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        """Close everything from this depth of the stack on."""
        if any(node >= 0 for _, node in self.stack[depth:]):
            self._flush()
        for tag, _ in self.stack[depth:]:
            self.links -= tag == "a"
        del self.stack[depth:]
        self.node = next(node for _, node in reversed(self.stack) if node >= 0)

    def _end_open(self, tags: frozenset, shield: frozenset) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag, node = self.stack[depth]
            if tag in tags:
                self._pop(depth)
                return
            if tag in shield or (node >= 0 and tag not in ("p", "dt", "dd", "li", "td", "th", "tr")):
                return

    def _end_head(self, tag: str) -> None:
        if self.unseen[:1] == ["head"] and (tag == "body" or (len(self.unseen) == 1 and tag not in HEAD)):
            self.unseen.clear()

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag in UNSEEN or (self.unseen and tag in BLOCK):
            self.unseen.append(tag)
        if self.unseen:
            return
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.buffer.append(" ")
            self.inputs[self.node] += tag == "input"
            return
        if tag in ("html", "body") and any(t == tag for t, _ in self.stack):
            return
        if tag in BLOCK:
            self._end_open(frozenset(["p"]), frozenset(["table"]))
            if tag in ENDED_BY:
                self._end_open(*ENDED_BY[tag])
            self._open(tag, attrs)
            return
        self.links += tag == "a"
        self.inputs[self.node] += tag in ("button", "textarea", "label")
        if len(self.stack) < 5000:
            self.stack.append((tag, -1))

    def handle_startendtag(self, tag, attrs):
        self._end_head(tag)
        if not self.unseen and tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
                return
            if tag not in BLOCK or all(t != tag for t, _ in self.stack[1:]):
                return
            self.unseen.clear()  # never closed: it ends with the block around it
        for depth in range(len(self.stack) - 1, 0, -1):
            here, node = self.stack[depth]
            if here == tag:
                self._pop(depth)
                return
            if node >= 0 and tag not in BLOCK:
                return

    def handle_data(self, data):
        if self.unseen == ["head"] and data.strip():
            self.unseen.clear()
        if not self.unseen:
            self.buffer.append(data)
            if self.links > 0:
                self.linked += len(data)


def parse(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page._flush()
    return page


#: Own and inherited attribute tokens, own and inherited tag groups, then 18 numbers.
OWN = len(TOKENS) + len(TAG_GROUPS)
WIDTH = 2 * OWN + 18


def features(page: Page) -> np.ndarray:
    """One row a node, in document order (a parent comes before its children)."""
    n = len(page.tag)
    parent = page.parent
    text, links, marks, count = [0] * n, [0] * n, [0] * n, [0] * n
    own = [0] * n
    for node, block, linked in page.blocks:
        text[node] += len(block)
        own[node] += len(block)
        links[node] += linked
        marks[node] += len(SENTENCE.findall(block))
        count[node] += 1
    below, inputs = [1] * n, list(page.inputs)
    paragraphs, items = [t == "p" for t in page.tag], [t in ("li", "dt", "dd") for t in page.tag]
    for k in range(n - 1, 0, -1):
        up = parent[k]
        for x in (text, links, marks, count, below, inputs, paragraphs, items):
            x[up] += x[k]
    x = np.zeros((n, WIDTH), dtype=np.float32)
    children: list[int] = [0] * n
    place, depth = [0] * n, [0] * n
    for k in range(1, n):
        place[k], depth[k] = children[parent[k]], depth[parent[k]] + 1
        children[parent[k]] += 1
    tokens, groups = len(TOKENS), len(TAG_GROUPS)
    whole = max(text[0], 1)
    inside = [False] * n
    for k in range(n):
        row, up = x[k], max(parent[k], 0)
        for t in page.tokens[k]:
            row[t] = 1
        row[tokens + GROUP_OF.get(page.tag[k], groups - 1)] = 1
        if k:
            np.maximum(x[up, :OWN], x[up, OWN : 2 * OWN], out=row[OWN : 2 * OWN])
        inside[k] = inside[up] or page.tag[k] in ("article", "main") if k else False
        row[-18:] = (
            depth[k], place[k], children[up], place[k] / max(children[up] - 1, 1), children[k], text[k], own[k], count[k],
            links[k] / max(text[k], 1), marks[k] / max(text[k], 1), text[k] / max(count[k], 1), text[k] / whole,
            text[k] / max(text[up], 1), below[k], paragraphs[k], items[k], inputs[k], page.hidden[k] * 2 + inside[k],
        )
    return x


def decode(parent: list[int], score: np.ndarray) -> np.ndarray:
    """Most likely labels where no node below a rejected one is kept."""
    n = len(parent)
    p = np.clip(score, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    reject, keep = list(no), list(yes)
    for k in range(n - 1, 0, -1):
        up = parent[k]
        reject[up] += reject[k]
        keep[up] += max(keep[k], reject[k])
    kept = np.zeros(n, dtype=bool)
    for k in range(n):
        kept[k] = (k == 0 or kept[parent[k]]) and keep[k] > reject[k]
    return kept


def extract(pages: list[str], model: trees.Boosted) -> list[str]:
    read = [parse(x) for x in pages]
    rows = [features(x) for x in read]
    scores = model.score(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, x in zip(read, rows, strict=True):
        kept = decode(page.parent, scores[at : at + len(x)])
        at += len(x)
        out.append("\n".join(text for node, text, _ in page.blocks if kept[node]))
    return out


def _teach(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article and the rest by element; None for others."""
    if "article" not in page.tag and "main" not in page.tag:
        return None
    wrong = ("nav", "aside", "footer", "header", "form", "dialog")
    n = len(page.tag)
    inside, y = [False] * n, np.zeros(n)
    for k in range(1, n):
        up = page.parent[k]
        bad = page.tag[k] in wrong or any(t in (1, 3, 4, 5, 6, 7) for t in page.tokens[k])
        inside[k] = (inside[up] or page.tag[k] in ("article", "main")) and not bad
        y[k] = inside[k]
    return _upwards(page, y)


def _upwards(page: Page, y: np.ndarray) -> np.ndarray:
    """What holds a kept node is kept."""
    for k in range(len(y) - 1, 0, -1):
        y[page.parent[k]] = max(y[page.parent[k]], y[k])
    return y


def _golden(page: Page) -> np.ndarray:
    """Labels of a made-up layout: data-gold on an element holds for all below it."""
    y = np.zeros(len(page.tag))
    for k in range(1, len(y)):
        y[k] = float(page.gold[k] == "1") if page.gold[k] is not None else y[page.parent[k]]
    return _upwards(page, y)


def _layout(rng: random.Random, paragraphs: list[str], other: list[str]) -> str:
    """A page with the paragraphs as its article among menus, notices and so on."""

    def words(low, high):
        return " ".join(rng.choice(other) for _ in range(rng.randint(low, high)))

    def sentence():
        return escape(rng.choice(paragraphs)[: rng.randint(30, 250)] if rng.random() < 0.4 else words(4, 30))

    def links(tag, attrs, low=3, high=9):
        own = "".join(f'<li><a href="#">{escape(words(1, 2))}</a></li>' for _ in range(rng.randint(low, high)))
        return f"<{tag} {attrs} data-gold='0'><ul>{own}</ul></{tag}>"

    def plain(tag, attrs):
        inner = sentence() if rng.random() < 0.5 else "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 3)))
        return f"<{tag} {attrs} data-gold='0'>{inner}</{tag}>"

    def token(*names):
        return rng.choice(("class", "id")) + f'="{rng.choice(names)}"'

    bare = rng.random() < 0.3
    menu = rng.choice((("nav", ""), ("nav", token("menu", "main-nav")), ("div", token("navbar", "menu", "nav")), ("div", token("breadcrumbs", "top-menu"))))
    parts = [links(*menu)] if rng.random() < 0.9 else []
    if rng.random() < 0.6:
        parts.append(plain(*rng.choice((("header", ""), ("div", token("header", "masthead", "site-header"))))))
    advert = lambda: plain(*rng.choice((("div", token("ad", "ads", "advert", "sponsored", "banner-ad", "promo")), ("ins", token("adsbygoogle")), ("aside", token("ad")))))
    notice = lambda: plain(*rng.choice((("div", token("notice", "cookie-notice", "cookie-consent", "alert")), ("div", 'role="alert"'), ("p", token("notice", "warning")), ("section", token("newsletter", "subscribe")))))
    side = lambda: rng.choice((links, plain))(*rng.choice((("aside", ""), ("aside", token("sidebar")), ("div", token("sidebar", "side", "related", "widget")))))
    form = lambda: f"<form data-gold='0' {token('search', 'login', 'signup') if rng.random() < 0.5 else ''}><label>{escape(words(1, 3))}</label><input><p>{sentence()}</p><button>{escape(words(1, 1))}</button></form>"

    def comments():
        one = lambda: f"<{(t := rng.choice(('div', 'li', 'article')))} class='comment'><p>{sentence()}</p></{t}>"
        tag, attrs = rng.choice((("section", token("comments")), ("div", token("comments", "discussion", "reader-comments")), ("ol", token("commentlist"))))
        return f"<{tag} {attrs} data-gold='0'><h3>{escape(words(1, 2))}</h3>{''.join(one() for _ in range(rng.randint(1, 5)))}</{tag}>"

    extras = [f for f in (advert, notice, side, form) if rng.random() < 0.45]
    before, within, after = [], [], []
    for make in extras:
        rng.choice((before, before, within, after))[:0] = [make()]
    if rng.random() < 0.4:
        rng.choice((within, after)).append(comments())
    body = []
    if rng.random() < 0.85:
        body.append(f"<{(t := rng.choice(('h1', 'h1', 'h2')))}>{escape(paragraphs[0][:60])}</{t}>")
    for text in paragraphs:
        style = rng.random()
        if style < 0.6:
            body.append(f"<p>{escape(text)}</p>")
        elif style < 0.75:
            body.append(f"<p><b>{escape(text)}<br>")
        elif style < 0.8:
            body.append(f"<h2>{escape(text[:50])}</h2><p>{escape(text)}</p>")
        elif style < 0.85:
            body.append(f"<ul><li>{escape(text)}</li><li>{escape(text[:40])}</li></ul>")
        elif style < 0.9:
            body.append(f"<blockquote><p>{escape(text)}</p></blockquote>")
        elif style < 0.95:
            body.append(f"<p>{escape(text[: len(text) // 2])} <a href='#'>{escape(text[len(text) // 2 :][:20])}</a></p>")
        else:
            body.append(f"<div>{escape(text)}</div>")
    for x in within:
        body.insert(rng.randint(0, len(body)) if "comment" not in x else len(body), x)
    main = rng.choice((("article", ""), ("article", ""), ("main", ""), ("div", token("content", "entry", "story", "post-body", "article", "main-content")), ("section", token("story", "content")), ("div", "")))
    whole = f"<{main[0]} {main[1]} data-gold='1'>{''.join(body)}</{main[0]}>"
    if rng.random() < 0.3:
        whole = f"<div {token('wrapper', 'page', 'container')}>{whole}{side() if rng.random() < 0.5 else ''}</div>"
    foot = plain(*rng.choice((("footer", ""), ("div", token("footer", "copyright"))))) if rng.random() < 0.9 else ""
    tail = "" if bare else "</body></html>"
    return f"<html><head><title>x</title></head><body>{''.join(parts)}{''.join(before)}{whole}{''.join(after)}{foot}{tail}"


def _filler(rng: random.Random) -> tuple[list[str], list[str]]:
    """Made-up paragraphs, and words for the rest of a page."""

    def word():
        return "".join(rng.choice("aeiou") + rng.choice("bcdfglmnprstv") for _ in range(rng.randint(1, 4)))

    def sentence():
        return " ".join(word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(3, 20))).capitalize() + "."

    return (
        [" ".join(sentence() for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))],
        [word() for _ in range(60)],
    )


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> trees.Boosted:
    """Boosted trees from pages that mark their article, and from made-up layouts of their texts."""
    rng = random.Random(seed)
    xs, ys, pool = [], [], []
    for html in pages:
        page = parse(html)
        y = _teach(page)
        if y is None or not y.any():
            continue
        xs.append(features(page))
        ys.append(y)
        kept = [t for node, t, _ in page.blocks if y[node]]
        rest = [w for node, t, _ in page.blocks if not y[node] for w in t.split()]
        if kept:
            pool.append((kept[:30], rest or ["more"]))
    pool += [_filler(rng) for _ in range(100 - len(pool))]
    for paragraphs, other in pool * layouts:
        own = paragraphs if rng.random() < 0.7 else paragraphs[: rng.randint(1, 3)]
        page = parse(_layout(rng, own, other))
        xs.append(features(page))
        ys.append(_golden(page))
    return trees.fit(np.concatenate(xs), np.concatenate(ys), rounds=40, depth=4, least=8)


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> trees.Boosted:
    """Fits on about ``sample`` different pages, chosen by a hash of their html; all if there are fewer.

    Copies count once, whatever their ids are, so no key can make the sample longer.
    """
    rows = pages.filter(F.length(html_col).between(1, SAMPLE_CHARS)).select(F.col(html_col).alias("html"))
    hashed = rows.withColumn("h", F.xxhash64("html"))
    chosen = hashed.filter(c.in_share(F.col("h"), sample / max(pages.count(), 1)))
    got = chosen.groupBy("h").agg(F.min("html").alias("html")).collect()
    return fit(sorted(r["html"] for r in got))


def main_text(
    pages: DataFrame, model: trees.Boosted | None = None, html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """The kept columns of pages (all but the html by default) as struct ``row``, and text."""
    model = model or train(pages, html_col)
    keep = [x for x in pages.columns if x != html_col] if keep is None else keep
    names = {x: f"c{i}" for i, x in enumerate(pages.columns)}
    kept = [names[x] for x in keep]
    flat = pages.toDF(*names.values()).select(*kept, F.col(names[html_col]).alias("html_"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            html = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.string()), "")
            texts = []
            for at in range(0, len(html), 200):
                texts.extend(extract(html.slice(at, 200).to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*kept, "text"])

    schema = "".join(f"{k} {flat.schema[k].dataType.simpleString()}, " for k in kept) + "text string"
    back = F.struct(*[F.col(names[x]).alias(x) for x in keep]).alias("row")
    return flat.mapInArrow(scan, schema).select(back, "text")
