"""Main text of HTML pages: gradient-boosted trees over DOM nodes and a decoding over the whole tree.

A page becomes a tree of its block elements (inline ones belong to the block around them). Each node has
features of its own (what its tag and attribute tokens are called, depth), of its subtree (text and its
density per tag, share of links, punctuation, paragraphs, fields) and of its place among its siblings. Spark
ML's trees give every node the log-odds of being part of the article. Decoding then gives every node one of
three states, the best ones for the page as a whole: out (with all below it), mixed (parts below may be in)
or in (parts below may be cut out, at a cost). Nothing can be in below what is out.

The trees learn from a bounded sample of the table's own pages: blocks inside ``article`` and ``main`` are
labelled as text, others as not. Since a table may know one layout only, each sampled page is also dressed
anew in several layouts with other tags, names and places, filled with its own texts.

Pages lie where they are: no shuffle but for the sample.
"""

from __future__ import annotations

import random
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, small_batches

#: Pages that the trees learn from at most, and new layouts of each.
SAMPLE_PAGES, LAYOUTS = 200, 4

#: What elements are called by, in tags or attribute tokens.
KINDS: dict[str, tuple[set[str], set[str]]] = {
    "content": ({"article", "main"}, set("article articles articlebody body content entry main post posts prose story text".split())),
    "nav": ({"nav", "menu"}, set("breadcrumb breadcrumbs crumbs menu nav navbar navigation pager pagination toc".split())),
    "header": ({"header"}, set("branding header logo masthead top topbar".split())),
    "footer": ({"footer"}, set("bottom colophon contentinfo copyright footer legal".split())),
    "side": ({"aside"}, set("aside complementary more popular rail recommended related secondary sidebar teaser teasers trending widget widgets".split())),
    "ad": ({"ins"}, set("ad ads adsbygoogle adslot advert advertisement adverts banner promo promotion sponsor sponsored".split())),
    "notice": ({"dialog"}, set("alert announcement banner consent cookie cookies disclaimer gdpr modal notice notification overlay paywall popup warning".split())),
    "comments": (set(), set("comment commentlist comments discussion disqus feedback replies reply respond responses".split())),
    "form": ({"form", "fieldset"}, set("contact form login newsletter register search signin signup subscribe subscription".split())),
    "share": (set(), set("bookmark follow share sharing social".split())),
}
_BITS = {name: 1 << i for i, name in enumerate(KINDS)}
_BY_TAG = {t: _BITS[k] for k, (tags, _) in KINDS.items() for t in tags}
_BY_TOKEN: dict[str, int] = {}
for _k, (_, _tokens) in KINDS.items():
    for _t in _tokens:
        _BY_TOKEN[_t] = _BY_TOKEN.get(_t, 0) | _BITS[_k]

#: Elements that hold no readable text; those of ``_RAW`` hold no markup either.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_SILENT = {"head", "noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "datalist"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "ins legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag ends an open element of the first set, looking no further up than one of the second.
_ENDS_P = _BLOCK - set("dd dt li td th tr tbody thead tfoot caption legend summary ins html body".split())
_CELL = {"td", "th", "table", "caption", "button", "body", "html"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+>|[^>]*+(?:>|\Z)))""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMED = {"class", "id", "role", "aria-label", "itemprop", "data-role"}
_PUNCTUATION = re.compile(r"[.,;:!?]")
_TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")

_TAGS = ("div", "section", "p", "li", "ul", "ol", "table", "blockquote", "body", "heading")
FEATURES = (
    *(f"is_{k}" for k in KINDS), *(f"in_{k}" for k in KINDS), *(f"tag_{t}" for t in _TAGS), "hidden",
    "depth", "own_chars", "chars", "page_share", "parent_share", "before_share", "tags", "density", "links", "link_share", "punctuation",
    "paragraphs", "items", "fields", "siblings", "place", "same_tag", "before_links", "after_links", "nearest_kind",
)


class Page:
    """Block elements of a page in order, with their parents, and its blocks of text."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.bits: list[int] = []
        self.hidden: list[bool] = []
        self.label: list[int] = []
        self.links: list[int] = []
        self.link_chars: list[int] = []
        self.fields: list[int] = []
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int]] = []
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._element("", "")
        self._read(html)
        self._flush()

    def _element(self, tag: str, attributes: str) -> None:
        bits, hidden, label = _BY_TAG.get(tag, 0), False, -1
        if len(attributes) > 1:
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), values[0] or values[1] or values[2]
                if name in _NAMED:
                    for token in _TOKENS.findall(value):
                        bits |= _BY_TOKEN.get(token.lower(), 0)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
                elif name == "data-main":
                    label = int(value == "1")
        self.parent.append(self._stack[-1][1] if self._stack else -1)
        self.tag.append(tag)
        self.bits.append(bits)
        self.hidden.append(hidden)
        self.label.append(label)
        for x in (self.links, self.link_chars, self.fields):
            x.append(0)
        self._push(tag, len(self.tag) - 1)

    def _push(self, tag: str, node: int) -> None:
        self._stack.append((tag, node))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1][1], text))
            self._text = []

    def _close(self, tag: str) -> None:
        while True:
            top, _ = self._stack[-1]
            if top in _BLOCK:
                self._flush()
            self._stack.pop()
            self._open[top] -= 1
            if top == tag:
                return

    def _implied(self, tags: set[str], bounds: set[str]) -> None:
        if any(self._open.get(t) for t in tags):
            for top, _ in reversed(self._stack):
                if top in tags:
                    self._close(top)
                    return
                if top in bounds:
                    return

    def _read(self, html: str) -> None:
        at, silent = 0, lambda: any(self._open.get(t) for t in _SILENT)
        quiet = False
        while m := _MARKUP.search(html, at):
            if m.start() > at and not quiet:
                self._data(html[at : m.start()])
            at = m.end()
            slash, tag, attributes = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                if self._open.get(tag):
                    self._close(tag)
                    quiet = silent()
                continue
            if tag in _ENDS_P and self._open.get("p"):
                self._implied({"p"}, _CELL)
            if tag in _ENDS:
                self._implied(*_ENDS[tag])
                quiet = silent()
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
                self.fields[self._stack[-1][1]] += tag == "textarea"
            elif tag == "br":
                self._text.append(" ")
            elif tag in ("input", "select", "button"):
                self.fields[self._stack[-1][1]] += 1
            if tag in _VOID or tag in _RAW:
                if tag == "hr":
                    self._flush()
                continue
            if tag in _BLOCK and not quiet:
                self._flush()
                self._element(tag, attributes)
                continue
            self.links[self._stack[-1][1]] += tag == "a"
            self._push(tag, self._stack[-1][1])
            quiet = quiet or tag in _SILENT
        if not quiet:
            self._data(html[at:])

    def _data(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self._text.append(text)
        if self._open.get("a"):
            self.link_chars[self._stack[-1][1]] += len(text)


def features(page: Page) -> np.ndarray:
    """A row of ``FEATURES`` for each node."""
    n = len(page.tag)
    parent = page.parent
    own, punctuation, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    for node, text in page.blocks:
        own[node] += len(text)
        punctuation[node] += len(_PUNCTUATION.findall(text))
        blocks[node] += 1
    tag = page.tag
    sums = np.stack([own, punctuation, np.array(page.links, float), np.array(page.link_chars, float), np.array([t == "p" for t in tag], float),
                     np.array([t == "li" for t in tag], float), np.array(page.fields, float), np.ones(n)])
    columns = sums.T.tolist()
    for i in range(n - 1, 0, -1):
        up, row = columns[parent[i]], columns[i]
        for k in range(8):
            up[k] += row[k]
    chars, punct, links, link_chars, paragraphs, items, fields, tags = np.array(columns).T
    depth, inside, nearest, children = [0] * n, list(page.bits), [0] * n, [[] for _ in range(n)]
    for i in range(1, n):
        up = parent[i]
        depth[i] = depth[up] + 1
        inside[i] |= inside[up]
        nearest[i] = page.bits[i] or nearest[up]
        children[up].append(i)
    siblings, place, same, left, right = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    link_share = link_chars / np.maximum(chars, 1)
    for i in range(n):
        kids = children[i]
        names: dict[str, int] = {}
        for c in kids:
            names[tag[c]] = names.get(tag[c], 0) + 1
        for k, c in enumerate(kids):
            siblings[c], place[c], same[c] = len(kids), k / len(kids), names[tag[c]] / len(kids)
            left[c] = link_share[kids[k - 1]] if k else 0
            right[c] = link_share[kids[k + 1]] if k + 1 < len(kids) else 0
    total = max(chars[0], 1)
    before = (np.cumsum(own) - own) / total
    bits, inside, nearest = np.array(page.bits), np.array(inside), np.array(nearest)
    each = lambda b: [(b >> i & 1).astype(float) for i in range(len(KINDS))]
    heading = {"h1", "h2", "h3", "h4", "h5", "h6"}
    named = [np.array([x in heading if t == "heading" else x == t for x in tag], float) for t in _TAGS]
    up = np.maximum(parent, 0)
    return np.column_stack([
        *each(bits), *each(inside), *named, np.array(page.hidden, float), depth, np.log1p(own), np.log1p(chars), chars / total, chars / np.maximum(chars[up], 1),
        before, np.log1p(tags), np.log1p(chars / tags), np.log1p(links), np.minimum(link_share, 1), punct / np.maximum(chars, 1), np.log1p(paragraphs), np.log1p(items),
        np.log1p(fields), np.log1p(siblings), place, same, left, right, np.log2(np.maximum(nearest & -nearest, 1)) + (nearest > 0),
    ]).astype(np.float32)


# --- training pages -------------------------------------------------------------------------------

#: Names that layouts are made of: tags and attribute values of each kind, and names that say nothing.
_NAMES = {
    "content": (["article", "main", "div", "section", "div"], ["content", "article", "post", "entry-content", "main-content", "story", "article-body", "post text", "articleBody", ""]),
    "nav": (["nav", "div", "ul", "nav"], ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "site-navigation", "pagination", "toc", ""]),
    "header": (["header", "div", "header"], ["header", "masthead", "site-header", "topbar", "branding", "logo", ""]),
    "footer": (["footer", "div", "footer"], ["footer", "site-footer", "colophon", "copyright", "legal", "bottom", ""]),
    "side": (["aside", "div", "section", "aside"], ["sidebar", "related", "widget", "right-rail", "recommended", "popular", "more teasers", "trending", "secondary", ""]),
    "ad": (["div", "aside", "ins", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbygoogle", "ad-slot"]),
    "notice": (["div", "section", "dialog", "p"], ["cookie-notice", "consent", "gdpr", "alert", "notice", "popup", "modal", "disclaimer", "announcement", "paywall", "cookies banner"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment-list", "responses", "discussion", "replies", "disqus", "reader-comments", "feedback"]),
    "form": (["form", "div", "form", "section"], ["newsletter", "subscribe", "signup", "login", "search", "contact-form", "comment-form", "register", ""]),
    "share": (["div", "ul", "p"], ["share", "social", "sharing", "follow-us", "bookmark"]),
}
_PLAIN = ["row", "col", "wrap", "box", "inner", "container", "page", "x1", "grid", "clearfix", ""]


def _tagged(tag: str, name: str, inner: str, label: int, pick: random.Random) -> str:
    named = f' {pick.choice(["class", "class", "id"])}="{name}"' if name else ""
    return f'<{tag}{named} data-main="{label}">{inner}</{tag}>'


def _boilerplate(kind: str, texts: list[str], pick: random.Random) -> str:
    """An element of the kind, filled with pieces of the page's texts."""
    words = " ".join(texts).split() or ["text"]

    def some(low: int, high: int) -> str:
        n = pick.randint(low, high)
        i = pick.randrange(max(1, len(words) - n))
        return " ".join(words[i : i + n]).replace("&", "&amp;").replace("<", "&lt;")

    links = lambda n: "".join(f'<li><a href="/{k}">{some(1, 4)}</a></li>' for k in range(n))
    listed = lambda n: f"<ul>{links(n)}</ul>"
    tags, names = _NAMES[kind]
    tag, name = pick.choice(tags), pick.choice(names)
    if not name and tag in ("div", "section", "ul", "p"):
        name = names[0]
    if kind == "nav":
        inner = links(pick.randint(2, 12)) if tag == "ul" else listed(pick.randint(2, 12)) if pick.random() < 0.8 else " ".join(f'<a href="#">{some(1, 2)}</a>' for _ in range(5))
    elif kind == "header":
        inner = f"<{(h := pick.choice(['h1', 'h2', 'div', 'p']))}>{some(1, 5)}</{h}>" + pick.choice(["", listed(4), f"<p>{some(3, 12)}</p>"])
    elif kind == "footer":
        inner = pick.choice(["", listed(5)]) + pick.choice([f"&copy; {some(2, 20)}", f"<p>&copy; {some(3, 30)}</p><p>{some(2, 12)}</p>"])
    elif kind == "side":
        inner = pick.choice([f"<h3>{some(1, 4)}</h3>{listed(5)}", f"<h3>{some(1, 4)}</h3><p>{some(5, 40)}</p>", f"<p>{some(4, 60)}</p>", f"<div><h4>{some(2, 6)}</h4><p>{some(6, 30)}</p></div>" * 3])
    elif kind == "notice":
        inner = pick.choice([some(3, 30), f"<p>{some(4, 40)}</p>", f"<h4>{some(1, 4)}</h4><p>{some(4, 30)}</p>"]) + pick.choice(["", "<button>OK</button>", '<a href="#">OK</a>'])
    elif kind == "comments":
        one = "li" if tag in ("ol", "ul") else pick.choice(["div", "article", "div"])
        each = [f'<{one} class="{pick.choice(["comment", "reply", "item", "comment-body"])}"><{(b := pick.choice(["b", "h4", "cite", "div"]))}>{some(1, 2)}</{b}>'
                + "".join(f"<p>{some(3, 60)}</p>" for _ in range(pick.randint(1, 3))) + f"</{one}>" for _ in range(pick.randint(1, 6))]
        inner = ("" if one == "li" else f"<h3>{some(1, 3)}</h3>") + "".join(each)
    elif kind == "form":
        inner = f"<{(b := pick.choice(['p', 'h3', 'label', 'div']))}>{some(1, 12)}</{b}>" + pick.choice(["", f"<label>{some(1, 3)}</label>"]) + '<input name="q"><button>Go</button>'
    elif kind == "share":
        inner = links(4) if tag == "ul" else " ".join(f'<a href="#">{some(1, 2)}</a>' for _ in range(4))
    else:
        inner = pick.choice([some(2, 40), f"<p>{some(3, 50)}</p>", f'<a href="#">{some(3, 20)}</a>', f"<h4>{some(2, 6)}</h4><p>{some(4, 30)}</p>"])
    return _tagged(tag, name, inner, 0, pick)


def layout(title: str, texts: list[str], pick: random.Random) -> str:
    """A page of another layout with these texts as its article; ``data-main`` says what is and is not."""
    quoted = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    body = pick.choice(["p", "p", "p", "p", "div"])
    parts = []
    for i, t in enumerate(texts):
        x = pick.random()
        if i and x < 0.06:
            parts.append(f"<h2>{quoted(' '.join(t.split()[:6]))}</h2>")
        if x > 0.95:
            parts.append("<ul>" + "".join(f"<li>{quoted(s)}</li>" for s in t.split(".") if s.strip()) + "</ul>")
        elif x > 0.91:
            parts.append(f"<blockquote>{quoted(t)}</blockquote>")
        else:
            link = t.split(" ", 3)
            parts.append(f'<{body}><a href="#">{quoted(link[0])}</a> {quoted(" ".join(link[1:]))}</{body}>' if x > 0.8 else f"<{body}>{quoted(t)}</{body}>")
        if pick.random() < 0.06:
            parts.append(_boilerplate(pick.choice(["ad", "side", "share", "form", "notice"]), texts, pick))
    heading = f"<{(h := pick.choice(['h1', 'h1', 'h2']))}>{quoted(title)}</{h}>"
    if pick.random() < 0.15:
        heading = f"<header>{heading}</header>"
    inner = heading + "".join(parts)
    for kind in ("share", "form", "comments"):
        if pick.random() < 0.12:
            inner += _boilerplate(kind, texts, pick)
    tag, name = pick.choice(_NAMES["content"][0]), pick.choice(_NAMES["content"][1])
    main = _tagged(tag, name or pick.choice(_PLAIN), inner, 1, pick)
    above = [_boilerplate(k, texts, pick) for k in ("notice", "header", "nav", "ad", "form") if pick.random() < 0.45]
    below = [_boilerplate(k, texts, pick) for k in ("share", "comments", "form", "side", "ad", "nav", "notice", "footer") if pick.random() < 0.45]
    beside = [_boilerplate("side", texts, pick) for _ in range(2) if pick.random() < 0.4]
    pick.shuffle(above)
    middle = [*beside, main] if pick.random() < 0.3 else [main, *beside]
    for _ in range(pick.choice([0, 0, 1, 2])):
        plain = pick.choice(_PLAIN)
        middle = [f'<div class="{plain}">{"".join(middle)}</div>']
    page = "".join([*above, *middle, *below])
    return f"<html><body>{page if pick.random() < 0.6 else f'<div>{page}</div>'}</body></html>"


def labels(page: Page) -> np.ndarray:
    """1 for nodes inside a labelled text, 0 for those outside that hold none, -1 for those that hold both.

    Labels go down until the next one. Pages without ``data-main`` have ``article`` and ``main`` as
    labelled texts, with whatever is called a kind of boilerplate in them cut out."""
    given = any(x >= 0 for x in page.label)
    y, holds = [0] * len(page.tag), [[False, False] for _ in page.tag]
    for i in range(1, len(y)):
        up = y[page.parent[i]]
        if given:
            y[i] = up if page.label[i] < 0 else page.label[i]
        else:
            y[i] = int(page.tag[i] in ("article", "main") or up == 1 and not page.bits[i] & ~_BITS["content"])
    for i in range(len(y) - 1, 0, -1):
        holds[i][y[i]] = True
        above = holds[page.parent[i]]
        above[0], above[1] = above[0] or holds[i][0], above[1] or holds[i][1]
    return np.array([-1 if h[1] and not x else x for x, h in zip(y, holds, strict=True)], np.int8)


def training_rows(html: str, layouts: int = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a page's nodes and of those of its new layouts; nodes without text are left out."""
    page = Page(html)
    y = labels(page)
    main = [t for node, t in page.blocks if y[node] == 1] or [t for node, t in page.blocks if page.tag[node] == "p"]
    pages = [page] if (y == 1).any() else []
    if main:
        pick = random.Random(zlib.crc32(html.encode()))
        pages += [Page(layout(main[0][:200], main[1:60] or main, pick)) for _ in range(layouts)]
    x, out = [np.zeros((0, len(FEATURES)), np.float32)], [np.zeros(0, np.int8)]
    for p in pages:
        f, y = features(p), labels(p)
        told = (y >= 0) & (f[:, FEATURES.index("chars")] > 0)
        x.append(f[told])
        out.append(y[told])
    return np.concatenate(x), np.concatenate(out)


class Trees:
    """Boosted trees as arrays, to be applied to many nodes at once."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            rows: list[list[float]] = []
            self._walk(tree._java_obj.rootNode(), rows)
            feature, threshold, left, right, value = np.array(rows).T
            self.trees.append((feature.astype(int), threshold, left.astype(int), right.astype(int), value * weight, tree.depth))

    def _walk(self, node, rows: list[list[float]]) -> int:
        here = len(rows)
        rows.append([0, np.inf, here, here, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[here][:2] = [split.featureIndex(), split.threshold()]
            rows[here][2] = self._walk(node.leftChild(), rows)
            rows[here][3] = self._walk(node.rightChild(), rows)
        return here

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value, depth in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = np.where(x[row, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return 2 * total


def fit(pages: DataFrame, scratch: Scratch, sample: int = SAMPLE_PAGES, trees: int = 25, depth: int = 4, seed: int = 7) -> Trees | None:
    """Trees from at most ``sample`` distinct pages, those first by a hash; None if there is no text to learn from."""

    def run(batches):
        for batch in batches:
            for html in batch.column(0).to_pylist():
                x, y = training_rows(html)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float64)), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([values, pa.array(y.astype(np.float64))], names=["x", "label"])
            release()

    texts = pages.select("html").filter(F.length("html") > 0)
    n = texts.count()
    if not n:
        return None
    share = min(1.0, 4 * sample / n)  # a superset of the first ones by hash, but for a chance of next to nothing
    h = F.xxhash64("html")
    some = texts.filter(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))).dropDuplicates(["html"]).orderBy(F.pmod(h, F.lit(1 << 30)), h).limit(sample)
    rows = scratch.keep(some.repartition(8).mapInArrow(run, "x array<double>, label double"), "nodes")
    if rows.select("label").distinct().count() < 2:
        return None
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed)
    return Trees(gbt.fit(rows.select(array_to_vector("x").alias("features"), "label")))


#: What a change from in to out below costs, and what a node pays for parts of both kinds.
CUT, MIX = 2.0, 0.5
_OUT, _MIXED, _IN = 0, 1, 2


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """The state of each node, the best ones for the page as a whole."""
    n = len(page.tag)
    own = [0] * n
    for node, text in page.blocks:
        own[node] += len(text)
    weight = 1 + np.log1p(own)
    gain = (np.clip(odds, -6, 6) * weight).tolist()
    best: list[list[float]] = [[-g, -MIX - (g if own[i] else 0), g] for i, g in enumerate(gain)]
    for i in range(n - 1, 0, -1):
        out, mixed, inside = best[i]
        up = best[page.parent[i]]
        up[_OUT] += out
        up[_MIXED] += max(out, mixed, inside)
        up[_IN] += max(out - CUT, inside)
    state = [_OUT] * n
    for i in range(n):
        out, mixed, inside = best[i]
        above = _MIXED if i == 0 else state[page.parent[i]]
        if above == _MIXED:
            state[i] = _IN if inside > max(out, mixed) else _MIXED if mixed > out else _OUT
        elif above == _IN:
            state[i] = _IN if inside > out - CUT else _OUT
    return state


def main_text(page: Page, odds: np.ndarray) -> str:
    state = decode(page, odds)
    return "\n\n".join(text for node, text in page.blocks if state[node] == _IN)


def extract(pages: DataFrame, model: Trees | None, id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(``id_cols``, text) of every page.

    Defined cases: null and empty pages, and pages without article text, have an empty text; pages of any
    length are read whole; broken markup is read as browsers do in the main (elements left open end with
    what is around them); repeated rows and null ids are rows of their own; extra columns are ignored; empty
    in, empty out.
    """
    small_batches(pages.sparkSession)
    schema = pages.select(*id_cols).schema.add("text", "string")

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                read = [Page(h or "") for h in batch.column(len(id_cols)).to_pylist()]
                rows = [features(p) for p in read]
                odds = model.log_odds(np.concatenate(rows)) if model else np.full(sum(map(len, rows)), -1.0)
                ends = np.cumsum([0, *map(len, rows)])
                texts = [main_text(p, odds[a:b]) for p, a, b in zip(read, ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(id_cols))), pa.array(texts, pa.string())], names=schema.fieldNames())
            release()

    return pages.select(*id_cols, "html").mapInArrow(run, schema)


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by trees that learn from these pages."""
    scratch = Scratch(pages.sparkSession, "main")
    out = extract(pages, fit(pages, scratch))
    return out.withColumn("n_chars", F.length("text").cast("long"))
