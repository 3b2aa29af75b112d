"""Main-text extraction by a tree-structured graphical model over the DOM.

Each block element of a page is a node that is content or not. A node has potentials from its own features (tag, cue words in class and id, link density,
length) and one with its parent; messages go up to the root and down again (sum-product, exact on a tree) and give each node's probability of
being content. Text of nodes at one half or more is kept. Weights are fitted to the likelihood's gradient, observed minus expected, on pages whose markup names
their article.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import in_small_batches, table

# The fit reads this many pages at most, none longer than TRAIN_CHARS (longer pages are extracted, not learned from).
TRAIN_PAGES, TRAIN_CHARS = 160, 20000
PASSES, RATE = 12, 0.1

# Element names of HTML by what they do to the text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "label nobr object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mtd semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What these hold is no text of the page: of the first up to the end tag whatever stands there, of the others all that is inside them. The third may hold their like.
RAW = frozenset("script style textarea".split())
DROPPED = frozenset("noscript template select iframe svg canvas button audio video datalist".split())
NESTING = frozenset("noscript template svg".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre search section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words in tags, classes, ids and roles that tell what a part of a page is for.
AWAY = frozenset(
    "nav navigation navbar menu menubar header masthead banner topbar footer foot copyright sidebar side aside complementary contentinfo widget related recommended ad ads "
    "advert adverts advertisement sponsor sponsored promo promotion notice notices cookie cookies consent gdpr alert popup modal newsletter subscribe "
    "signup login form search comment comments reply replies respond discussion disqus breadcrumb breadcrumbs pagination pager share sharing social toolbar "
    "tags skip disclaimer legal dialog".split()
)
HERE = frozenset("article main content body post entry story text".split())
AWAY_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
CUE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    away: bool = False
    here: bool = False
    chars: int = 0
    linked: int = 0
    features: list[int] = field(default_factory=list)


def _cues(tag: str, attributes: str) -> tuple[bool, bool]:
    away, here = tag in AWAY_TAGS, tag in ("article", "main")
    for m in CUE.finditer(attributes):
        parts = PART.findall((m[1] or m[2] or m[3] or "").lower())
        away = away or any(p in AWAY for p in parts)
        here = here or any(p in HERE for p in parts)
    return away, here and not away


@dataclass
class Tag:
    """A tag, a comment or a raw element of a page from `start` to `end`; comments and what is dropped have no name."""

    start: int
    end: int
    name: str = ""
    ends: bool = False
    attributes: str = ""


def _raw_end(page: str, low: str, tag: Tag, closes: list[int]) -> int:
    """Where a raw element ends: behind its end tag, or with the page. One written as empty ends at once if another begins before any end tag."""
    place = bisect_left(closes, tag.end)
    close = closes[place] if place < len(closes) else -1
    if tag.attributes.rstrip().endswith("/") and (close < 0 or low.find(f"<{tag.name}", tag.end, close) >= 0):
        return tag.end
    shut = page.find(">", close) if close >= 0 else -1
    return shut + 1 if shut >= 0 else len(page)


def tags(page: str) -> list[Tag]:
    """The tags of a page in one pass; a bare < is text. What dropped elements hold is one entry without a name."""
    low, out, at = page.lower(), [], 0
    if len(low) != len(page):
        low = page  # a letter whose lower case is longer: raw end tags are then told by their case
    closes: dict[str, list[int]] = {}  # where the end tags of raw elements begin, by name
    more = True  # whether there is a > ahead
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            shut = page.find("-->", at + 4)
            out.append(Tag(at, shut + 3 if shut >= 0 else len(page)))
        elif more and page[at + 1 : at + 2] in ("!", "?"):
            shut = page.find(">", at)
            more = shut >= 0
            if not more:
                at += 1
                continue
            out.append(Tag(at, shut + 1))
        elif m := TAG.match(page, at):
            tag = Tag(at, m.end(), m[2].lower(), m[1] == "/", m[3])
            if tag.name in RAW and not tag.ends:
                if tag.name not in closes:
                    closes[tag.name] = [m.start() for m in re.finditer(f"</{tag.name}", low)]
                tag = Tag(at, _raw_end(page, low, tag, closes[tag.name]))
            elif tag.name in RAW:
                tag = Tag(at, tag.end)
            out.append(tag)
        else:
            at += 1
            continue
        at = out[-1].end
    return _without_dropped(out)


def _without_dropped(found: list[Tag]) -> list[Tag]:
    """Replace each dropped element that has an end by one entry. One that is not closed before the next of its kind, or whose end lies beyond an article's edge, is
    only a tag, so what follows it stays. A noscript with the page's only article in it is no more than its tags either."""
    open_: dict[str, list[int]] = {}
    pairs, article = [], [0]
    for i, tag in enumerate(found):
        article.append(article[-1] + (tag.name in ("article", "main")))
        if tag.name not in DROPPED:
            continue
        held = open_.setdefault(tag.name, [])
        if tag.ends:
            if held:
                pairs.append((held.pop(), i))
        elif not tag.attributes.rstrip().endswith("/"):
            if tag.name not in NESTING:
                held.clear()
            held.append(i)
    inside = lambda a, b: article[b] - article[a]  # noqa: E731  edges of articles between two tags
    scripted = [(a, b) for a, b in pairs if found[a].name == "noscript"]
    outer, upto = 0, -1
    for a, b in sorted(scripted):
        if a > upto:
            outer, upto = outer + inside(a, b), b
    only = outer == article[-1]
    kept = [(a, b) for a, b in pairs if not inside(a, b) or found[a].name == "template" or found[a].name == "noscript" and not only]
    out, at = [], 0
    for a, b in sorted(kept):
        if a < at:
            continue
        out += found[at:a]
        out.append(Tag(found[a].start, found[b].end))
        at = b + 1
    return [t if t.name not in DROPPED else Tag(t.start, t.end) for t in out + found[at:]]


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The nodes of a page in order (parents first; node 0 is the page), and its runs of text as (block, node, text).

    Runs of one block are on one line. End tags that HTML leaves out are added; end tags without a start are ignored. A bare < is text."""
    nodes, runs = [Node("page", -1)], []
    stack = [0]
    held: Counter[str] = Counter()  # how many elements of each name are open
    block, links, at = 0, 0, 0

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            node = nodes[stack[-1]]
            size = len(piece.strip())
            node.chars += size
            node.linked += size if links else 0
            runs.append((block, stack[-1], piece))

    def close(to: int) -> None:
        held.subtract(nodes[i].tag for i in stack[to:])
        del stack[to:]

    for found in tags(page):
        text(page[at : found.start])
        at = found.end
        tag, ends, attributes = found.name, found.ends, found.attributes
        if not tag:
            continue
        if tag == "br":
            runs.append((block, stack[-1], " "))
            continue
        if tag in INLINE and (ends or tag in VOID or not any(_cues(tag, attributes))):
            if tag == "a":
                links = 0 if ends else 1
            if not ends or nodes[stack[-1]].tag != tag:
                continue
        if ends:
            if held[tag] > 0:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
                block += tag not in INLINE
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag in CLOSES_P and nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
            block += 1
        elif tag in SIBLINGS and any(held[t] > 0 for t in SIBLINGS[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in SIBLINGS[tag]:
                    close(depth)
                    block += 1
                    break
                if nodes[stack[depth]].tag in ("ul", "ol", "dl", "table", "menu", "div", "article", "section"):
                    break
        if tag not in INLINE:
            block += 1
            links = 0
        if attributes.rstrip().endswith("/") and tag not in INLINE and "=" not in attributes.rstrip()[-3:]:
            continue
        away, here = _cues(tag, attributes)
        if tag == "header" and held["article"] > 0:
            away = any(_cues("div", attributes)[:1])  # the head of the article itself
        nodes.append(Node(tag, stack[-1], away, here))
        stack.append(len(nodes) - 1)
        held[tag] += 1
    text(page[at:])
    for node in nodes:
        node.features = _features(node)
    return nodes, runs


# Features by name. Only the frame of a page is told by its tag: what a list or a table is for, its surroundings say.
FRAME = ["page", "html", "head", "title", "body"]
NAMES = ["away", "here", "links", "linked", "long", "short", "empty", *(f"tag {t}" for t in FRAME)]
INDEX = {n: i for i, n in enumerate(NAMES)}


def _features(node: Node) -> list[int]:
    out = [INDEX[f"tag {node.tag}"]] if node.tag in FRAME else []
    if node.away:
        out.append(INDEX["away"])
    if node.here:
        out.append(INDEX["here"])
    if node.chars and 2 * node.linked > node.chars:
        out.append(INDEX["links"])
    elif node.linked:
        out.append(INDEX["linked"])
    out.append(INDEX["empty" if not node.chars else "long" if node.chars >= 80 else "short"])
    return out


@dataclass
class Model:
    """own: weight of each feature for content. pair[a][b]: weight of a node in state b under a parent in state a."""

    own: np.ndarray
    pair: np.ndarray


def prior() -> Model:
    """What holds before any page is seen: parts named as boilerplate are not content, a head is none, and children follow their parents."""
    own = np.zeros(len(NAMES))
    own[INDEX["away"]], own[INDEX["here"]], own[INDEX["links"]] = -8.0, 4.0, -1.0
    own[INDEX["tag head"]] = own[INDEX["tag title"]] = -8.0
    own[INDEX["tag page"]] = own[INDEX["tag html"]] = own[INDEX["tag body"]] = 1.0
    return Model(own, np.log(np.array([[0.995, 0.005], [0.2, 0.8]])))


def marginals(nodes: list[Node], model: Model) -> tuple[list[float], np.ndarray]:
    """Each node's probability of content, and the expected number of (parent state, child state) pairs."""
    n = len(nodes)
    own = model.own
    score = [float(sum(own[f] for f in node.features)) for node in nodes]
    pair = [[exp(v) for v in row] for row in model.pair.tolist()]
    # upward: the weight of what hangs below a node for its two states; scaled at each node
    low0, low1 = [1.0] * n, [1.0] * n
    up0, up1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        s = max(-30.0, min(30.0, score[i]))
        a, b = low0[i], low1[i] * exp(s)
        low0[i], low1[i] = a / (a + b), b / (a + b)
        p = nodes[i].parent
        if p >= 0:
            m0 = pair[0][0] * low0[i] + pair[0][1] * low1[i]
            m1 = pair[1][0] * low0[i] + pair[1][1] * low1[i]
            up0[i], up1[i] = m0 / (m0 + m1), m1 / (m0 + m1)
            low0[p], low1[p] = low0[p] * up0[i], low1[p] * up1[i]
            if low0[p] + low1[p] < 1e-200:
                scale = low0[p] + low1[p] or 1.0
                low0[p], low1[p] = low0[p] / scale, low1[p] / scale
    # downward: a node's belief without what the child itself said, passed on to the child
    out = [0.0] * n
    pairs = np.zeros((2, 2))
    for i in range(n):
        p = nodes[i].parent
        if p < 0:
            out[i] = low1[i]
            continue
        c0, c1 = (1 - out[p]) / max(up0[i], 1e-300), out[p] / max(up1[i], 1e-300)
        w = (c0 * pair[0][0] * low0[i], c0 * pair[0][1] * low1[i], c1 * pair[1][0] * low0[i], c1 * pair[1][1] * low1[i])
        total = sum(w) or 1.0
        out[i] = (w[1] + w[3]) / total
        pairs += np.array(w).reshape(2, 2) / total
    return out, pairs


def marked(nodes: list[Node]) -> list[int] | None:
    """States by the markup: inside an article and not inside a part named otherwise. None if the page names no article."""
    if not any(n.tag == "article" for n in nodes):
        return None
    inside, out = [], []
    for n in nodes:
        above = inside[n.parent] if n.parent >= 0 else 0
        now = -1 if n.away or n.tag == "head" or above == -1 else 1 if n.tag == "article" or above == 1 else 0
        inside.append(now)
        out.append(1 if now == 1 or (now == 0 and n.tag in ("page", "html", "body")) else 0)
    return out


def fit(pages: list[str], passes: int = PASSES) -> Model:
    """Climb the likelihood of the marked states, starting from and drawn to the prior; pages without an article are left out."""
    model, start = prior(), prior()
    known = [(nodes, states) for nodes, states in ((n, marked(n)) for n, _ in map(parse, pages)) if states]
    for turn in range(passes if known else 0):
        own, pair, count = np.zeros(len(NAMES)), np.zeros((2, 2)), 0
        for nodes, states in known:
            guess, pairs = marginals(nodes, model)
            for node, state, p in zip(nodes, states, guess):
                for f in node.features:
                    own[f] += state - p
                if node.parent >= 0:
                    pair[states[node.parent], state] += 1
            pair -= pairs
            count += len(nodes)
        rate = RATE * (1 - turn / passes) * 100
        model.own += rate * (own / count - 0.001 * (model.own - start.own))
        model.pair += rate * (pair / count - 0.001 * (model.pair - start.pair))
    return model


def main_text(page: str, model: Model) -> str:
    """The kept blocks of a page, each on a line: references decoded, white space made one space, trimmed."""
    nodes, runs = parse(page)
    chance, _ = marginals(nodes, model)
    lines, held, last = [], [], -1
    for block, node, piece in runs:
        if chance[node] < 0.5:
            continue
        if block != last:
            lines.append("".join(held))
            held, last = [], block
        held.append(piece)
    lines.append("".join(held))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def training_pages(pages: DataFrame, most: int = TRAIN_PAGES) -> list[str]:
    rows = pages.select(F.col("html").cast("string").alias("html")).filter(F.col("html").isNotNull() & (F.length("html") <= TRAIN_CHARS))
    # picked by hash, and the hashes before the pages, so that only picked pages move
    picked = rows.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(most)
    return [r["html"] for r in rows.withColumn("h", F.xxhash64("html")).join(F.broadcast(picked), "h").dropDuplicates(["h"]).select("html").collect()]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; n_chars counts code points.

    Null and empty html gives an empty text. Repeated pages give the same text. Pages without an article are judged by the same model. No page is cut.
    Without any page to learn from the prior weights hold."""
    model = fit(training_pages(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_small_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
