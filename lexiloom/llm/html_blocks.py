"""Operator 10: main text of web pages from flat blocks and a decision tree.

A page becomes a flat list of text blocks in page order. Each block has the word
count and link density of itself and of its neighbours, its share of the page's
words, and what its markup says (kind of element, containers around it). A small
decision tree (Gini splits, grown in numpy) tells content from the rest. Its
labelled table is made of the blocks of the hand-labelled pages in ``html_samples``.

What containers say, as features: whether the block is in an ``article`` or ``main``
element, or in one whose class or id names content; how many marked containers
(navigation, asides, footers, headers that are not an article's own, and class names
all of whose words speak of such things) are around it, not counting those that
wrap the page's article; and how much of the page's unlinked words stand outside its
form, as a form may wrap a whole page.

Defined results: null html counts as empty; a page without content blocks gives
an empty string; unclosed and stray tags are borne; scripts, styles, templates
and comments never are text; a tag that is never closed by ``>`` is text; repeated
rows give repeated results; an empty table gives no rows; columns besides page_id,
url and html are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from lexiloom.llm.common import map_batches, spread, table
from lexiloom.llm.html_samples import SAMPLES

OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|!\[CDATA\[|[!?])")
#: What stands between a tag's name and its end; quotes count after an equals sign only.
TAIL = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSEEN = re.compile(r"visibility\s*:\s*hidden", re.IGNORECASE)
SPACES = re.compile(r"\s+")
#: A tag that closes itself; a slash at the end of an unquoted value is part of that.
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
WORDS = re.compile(r"[a-z]+")

# Elements that begin a block, elements without an end, elements whose
# inside is no text, elements that hold no main text, and words of class names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe textarea select annotation annotation-xml title desc metadata defs".split())
MARKED = frozenset("nav header footer aside menu button dialog head".split())
MAIN = frozenset("article main".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe sidebar side widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu topmenu nav navbar navigation footer header masthead toolbar pagination pager comment comments respond reply replies disqus login signup signin search copyright contentinfo complementary hidden skip".split())
#: Words that may stand beside one of those without changing what it says.
PLAIN_WORDS = frozenset("a and area bar block body bottom box bottoms button buttons center col column container content entry entries form global group holder icons inner item items left link links list lists main middle mobile module outer page panel post posts primary right row section secondary site slot small strip text thread title top unit user users wide wrap wrapper x article articles story stories media message messages".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
#: Elements whose open tag closes an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}


@dataclass
class Box:
    """An element that says something of the blocks in it; the last four are sums over it and what is around it."""

    within: Box | None = field(repr=False)
    marked: bool = False
    main: bool = False
    named: bool = False
    form: bool = False
    free: bool = False
    words: int = 0
    marks: int = 0
    in_main: bool = False
    in_named: bool = False
    in_form: int = 0


@dataclass
class Block:
    text: str
    tag: str
    words: int
    linked: int
    box: Box = field(repr=False)

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def tokens(html: str):
    """(text, None, "", "") and ("", closing?, tag, attributes) in order; what is never text is left out.

    Linear: a search for an end that failed is not made again.
    """
    at, upto, none, strict = 0, 0, set(), True

    def find(end: str, start: int) -> int:
        if end in none:
            return -1
        found = re.compile(re.escape(end), re.IGNORECASE).search(html, start)
        if not found:
            none.add(end)
        return found.start() if found else -1

    while m := OPEN.search(html, at):
        if m[2] is None:
            end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            stop = find(end, m.end())
            if upto < m.start():
                yield html[upto : m.start()], None, "", ""
            at = upto = len(html) if stop < 0 else stop + len(end)
            continue
        tail = TAIL.match(html, m.end()) if strict else None
        strict = bool(tail)
        stop = tail.end() if tail else find(">", m.end()) + 1
        if not stop:  # no tag ends any more
            break
        if upto < m.start():
            yield html[upto : m.start()], None, "", ""
        tag, attributes = m[2].lower(), html[m.end() : stop - 1]
        at = upto = stop
        if tag in SILENT and not m[1] and not SELF_CLOSED.search(attributes):
            end = find(f"</{tag}", stop)
            if end >= 0:
                at = upto = find(">", end) + 1 or len(html)
            elif tag in ("script", "style"):
                at = upto = len(html)
            continue
        yield "", bool(m[1]), tag, attributes
    if upto < len(html):
        yield html[upto:], None, "", ""


def says(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether class, id, role or state mark an element as no main text, and whether they name it as such.

    A header is an article's own one where it stands ``inside`` a main element, or where its name says so (entry-header).
    """
    marked = named = False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and UNSEEN.search(value):
            marked = True
        elif name in ("class", "id", "role", "itemprop", "aria-label"):
            for one in value.strip("\"'").lower().split():
                words = WORDS.findall(one)
                chrome, main = [w for w in words if w in CHROME_WORDS], any(w in MAIN_WORDS for w in words)
                own = set(chrome) == {"header"} and (inside or main)
                if chrome and not own and tag not in ("html", "body") and all(w in CHROME_WORDS or w in PLAIN_WORDS for w in words):
                    marked = True
                named |= main
    return marked, named and not marked


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order; one ends wherever a block element begins or ends."""
    out: list[Block] = []
    stack: list[tuple[str, Box | None]] = []
    block_at: list[int] = []  # where in the stack block elements are
    open_tags: Counter = Counter()
    boxes: list[Box] = []
    top = box = Box(None)
    parts: list[tuple[str, bool]] = []
    tag_of_block = "body"

    def pop_to(depth):
        nonlocal box
        while len(stack) > depth:
            tag, held = stack.pop()
            open_tags[tag] -= 1
            if held:
                box = held.within
        while block_at and block_at[-1] >= depth:
            block_at.pop()

    def flush():
        text = SPACES.sub(" ", unescape("".join(t for t, _ in parts))).strip()
        if text:
            linked = sum(len(unescape(t).split()) for t, a in parts if a)
            out.append(Block(text, tag_of_block, len(text.split()), linked, box))
            box.words += max(0, out[-1].words - linked)
        parts.clear()

    for text, closing, tag, attributes in tokens(html):
        if closing is None:
            parts.append((text, open_tags["a"] > 0))
            continue
        if tag == "br":
            parts.append((" ", False))
        if tag in BLOCKS or tag in MARKED:
            flush()
        if closing:
            if open_tags[tag]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in VOID and not SELF_CLOSED.search(attributes):
            # inline elements (b, i, a ...) left open inside go with the element that is closed
            if tag in CLOSES and block_at and stack[block_at[-1]][0] in CLOSES[tag]:
                pop_to(block_at[-1])
            inside = any(open_tags[t] for t in MAIN)
            marked, named = says(tag, attributes, inside) if attributes and (tag in BLOCKS or tag in MARKED or tag == "span") else (False, False)
            marked |= tag in MARKED and not (tag == "header" and inside)
            held = None
            if marked or named or tag in MAIN or tag == "form":
                held = box = Box(box, marked, tag in MAIN, named, tag == "form")
                boxes.append(box)
            open_tags[tag] += 1
            if tag in BLOCKS:
                block_at.append(len(stack))
            stack.append((tag, held))
        if tag in BLOCKS:
            tag_of_block = stack[block_at[-1]][0] if block_at else "body"
    flush()
    _weigh(top, boxes)
    return out


def _weigh(top: Box, boxes: list[Box]) -> None:
    """Sums over elements and what is around them; ``boxes`` has outer ones before inner ones.

    What wraps the article, the main element with the fewest marks around it, does not say what the article is.
    """
    for b in reversed(boxes):
        b.within.words += b.words
    around = {id(top): 0}
    for b in boxes:
        around[id(b)] = around[id(b.within)] + b.marked
    mains = [b for b in boxes if b.main and b.words]
    least = min((around[id(b)] for b in mains), default=0)
    for b in mains:
        while around[id(b)] <= least and not b.free and b is not top:
            b.free, b = True, b.within
    for b in boxes:
        w = b.within
        b.marks, b.in_main, b.in_named = w.marks + (b.marked and not b.free), w.in_main or b.main, w.in_named or b.named
        b.in_form = max(w.in_form, b.words if b.form and not b.free else 0)


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "marks", "outside_form", "main", "named", "heading", "item")


def features_of(blocks: list[Block]) -> np.ndarray:
    """Rows of FEATURES; a missing neighbour has no words and no links."""
    x = np.zeros((len(blocks), len(FEATURES)))
    words, density = np.array([b.words for b in blocks], float), np.array([b.density for b in blocks])
    plain = sum(max(0, b.words - b.linked) for b in blocks)
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
    for i, b in enumerate(blocks):
        outside = 1 - b.box.in_form / plain if b.box.in_form and plain else 0.0
        x[i, 6:] = (b.box.marks, outside, b.box.in_main, b.box.in_named, b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "td", "th", "dt", "dd"))
    return x


def labelled(pages=SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """The table of labelled blocks: FEATURES, and 1 for main text (marked by ``+`` in the pages)."""
    xs, ys = [], []
    for page in pages:
        found = blocks_of(page)
        for b in found:
            ys.append(float(b.text.startswith("+")))
            b.words -= int(ys[-1])  # the mark is no word
        xs.append(features_of(found))
    return np.concatenate(xs), np.array(ys)


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = 2) -> Node:
    """CART: the split with the lowest Gini impurity, first feature and lowest cut on ties."""
    node = Node(float(y.mean()))
    if depth == 0 or node.value in (0.0, 1.0):
        return node
    best = (node.value * (1 - node.value) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n, p = low.sum(), y[low].mean()
            q = y[~low].mean()
            if min(n, len(y) - n) >= least and (cost := n * p * (1 - p) + (len(y) - n) * q * (1 - q)) < best[0] - 1e-12:
                best = (cost, f, float(cut))
    _, node.feature, node.cut = best
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    """Share of content in each row's leaf."""
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[low], out[~low] = predict(node.low, x[low]), predict(node.high, x[~low])
    return out


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled(), depth=8, least=2)


def main_text(html: str | None) -> str:
    """Content blocks of a page, joined by two newlines."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, p in zip(blocks, predict(tree(), features_of(blocks))) if p >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def body(cols):
        texts = [main_text(h) for h in cols["html"].to_pylist()]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": list(map(len, texts))}

    rows = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "CAST(html AS STRING) AS html")
    return map_batches(rows, body, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages")))


#: DuckDB, for pages like those of the tables: the article is one article element of headings and paragraphs, and of the
#: references only those of the ampersand and the quotation mark occur in it. ``tests/llm/test_html.py`` has other pages.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts FROM pages
), b AS (SELECT page_id, url, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM a
), c AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(regexp_replace(part, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b
), g AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM c GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM g
"""
