"""Main text of web pages: flat text blocks, classified by a decision tree over a block and its neighbours.

A page is cut into blocks at block-level tags.  A block is described by its words and link density, those of the blocks before
and behind it, and by where it stands (inside an article, inside a container that is named for something else, a heading).
The tree is fitted by Spark on a small table of labelled blocks, which comes from the short pages of ``html_examples``; tasks
get it as a nested tuple.  A page is handled in one task, in time linear in its length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm.common import columns_of, over_batches
from contactspark.llm.html_examples import PAGES

# fixed values: element names of HTML
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button title".split())
RAW = frozenset("script style textarea title iframe".split())  # without an end tag they run to the end of the page
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# words in class, id or role that name something other than the article
NAMED = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share|sharing|"
    r"social|sidebar|side|widget|related|recommend\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|reply|replies|disqus|"
    r"respond|search|pagination|pager|copyright|legal|disclaimer|skip|hidden|complementary|contentinfo)", re.I)
PARTS = re.compile(r"[_-]+")
STATES = frozenset("with without no not has is overflow open closed enabled disabled".split())  # a token with one of these tells of a state
BOXES = frozenset("area bar block box buttons container inner items left links list posts right section wrap wrapper".split())  # last parts that say nothing
# what stays outside even with most of the page's words
NEVER = re.compile(
    r"(?:ads?|advert\w*|adsense|cookies?|consent|gdpr|footer|foot|contentinfo|comments?|commentlist|reply|replies|disqus|respond|menu|nav|navbar|navigation|copyright|legal|disclaimer|notice|alert|popup|modal|"
    r"newsletter|subscribe\w*|signup|login|share|sharing|social|related|recommend\w*|search|pagination|pager)", re.I)
OWN = frozenset("article content entry page post section".split())  # their headers belong to the article
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    outside: bool
    inside: bool
    heading: bool
    marked: bool


def _named(value: str) -> str:
    """The last telling part of a token that names something other than the article, or nothing."""
    for token in value.lower().split():
        parts = PARTS.split(token)
        if STATES.intersection(parts):
            continue
        while len(parts) > 1 and (parts[-1] in BOXES or not parts[-1]):
            parts.pop()
        if NAMED.fullmatch(parts[-1]) and not (parts[-1] == "header" and OWN.intersection(parts[:-1])):
            return parts[-1]
    return ""


def _foreign(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, whether it is a container for something other than the article, and whether it stays so whatever it holds.

    A header inside an article is part of it.
    """
    hidden, other = False, name in OUTSIDE or name == "header" and not inside
    never = other
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        hidden = hidden or key == "hidden" or key == "aria-hidden" and value.lower() == "true"
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main") and (part := _named(value)):
            other, never = True, never or bool(NEVER.fullmatch(part))
    return hidden, other, never


def _released(out: list[Block], within: list[int], parent: list[int], never: list[bool]) -> None:
    """Containers with most of the page's words are no longer outside, unless an article stands beside them.

    Footers, navigation, forms, asides, comments, adverts, notices and the like stay outside, but for one that holds all words of the page.
    """
    if any(b.inside and not b.outside and w < 0 for b, w in zip(out, within, strict=True)):
        free = [False] * len(parent)
    else:
        words = [0] * len(parent)
        for b, w in zip(out, within, strict=True):
            if w >= 0:
                words[w] += b.words
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] >= 0:
                words[parent[i]] += words[i]
        every = sum(b.words for b in out)
        free = [n == every if never[i] else 2 * n > every for i, n in enumerate(words)]
    bad: list[bool] = []
    for i, up in enumerate(parent):
        bad.append(not free[i] or up >= 0 and bad[up])
    for b, w in zip(out, within, strict=True):
        b.outside = b.outside or w >= 0 and bad[w]


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order.  Unclosed, crossed and cut-off tags are taken as browsers take them, near enough."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether each is hidden, and whether it is a foreign container
    parent: list[int] = []  # of each foreign container the one around it, -1 if there is none
    never: list[bool] = []  # whether it stays outside
    within: list[int] = []  # of each block the innermost foreign container
    opened: dict[str, int] = {}  # open elements by name
    endless: set[str] = set()  # skipped elements without a further tag
    inner = -1
    pieces: list[tuple[str, bool]] = []  # text and whether it is linked
    foreign = articles = links = headings = 0
    marked = False

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(t for t, _ in pieces))).strip()
            if text:
                total = len(text.split())
                linked = sum(len(html.unescape(t).split()) for t, link in pieces if link)
                within.append(inner)
                out.append(Block(text, total, min(linked, total), foreign > 0, articles > 0, headings > 0, marked))
            pieces = []

    def pop(name: str) -> None:
        nonlocal foreign, articles, links, headings, inner
        # an end tag without its element costs nothing, any other as much as it closes
        closed = not opened.get(name)
        while not closed:
            gone, bad, other = stack.pop()
            opened[gone] -= 1
            foreign -= bad
            inner = parent[inner] if other else inner
            articles -= gone in ("article", "main")
            links -= gone == "a"
            headings -= gone in HEADINGS
            closed = gone == name

    at = 0
    while True:
        tag = TAG.search(page, at)
        text = page[at:tag.start() if tag else len(page)]
        if text:
            pieces.append((text, links > 0))
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        ends, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in SKIPPED and not ends:
            if name in RAW:
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = over.end() if over else len(page)
            elif name not in endless and not (name in ("svg", "math") and attributes.endswith("/")):
                # one that has no end tag before the next of its kind is left open: what follows is text
                over = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if not over:
                    endless.add(name)
                elif over[1]:
                    at = over.end()
            pieces.append((" ", False))
            continue
        if name == "br":
            pieces.append((" ", False))
            continue
        if name in BLOCKS:
            close()
        if ends:
            pop(name)
            continue
        if name in VOID:
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            pop("p")
        if name in ("li", "p", "tr", "td", "dd", "dt", "option") and stack and stack[-1][0] == name:
            pop(name)
        bad, other, stays = _foreign(name, attributes, articles > 0)
        stack.append((name, bad, other))
        opened[name] = opened.get(name, 0) + 1
        foreign += bad
        if other:
            parent.append(inner)
            never.append(stays)
            inner = len(parent) - 1
        articles += name in ("article", "main")
        links += name == "a"
        headings += name in HEADINGS
        marked = "data-main" in attributes if name in BLOCKS else marked
    close()
    _released(out, within, parent, never)
    return out


FEATURES = 9


def features(found: list[Block]) -> np.ndarray:
    """One row per block: words and link density of the block before it, itself and the block behind it, then where it stands."""
    if not found:
        return np.zeros((0, FEATURES))
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked for b in found]) / words
    # what lies outside counts as no neighbour: an article's first line is the same with or without an advert before it
    own = np.array([not b.outside for b in found])
    w, d = np.concatenate([[0], words * own, [0]]), np.concatenate([[0], density * own, [0]])
    return np.column_stack([
        w[:-2], d[:-2], words, density, w[2:], d[2:], [b.outside for b in found], [b.inside for b in found], [b.heading for b in found]])


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled blocks of the example pages: ``x, label``."""
    rows = [([float(v) for v in x], float(b.marked)) for page in PAGES for found in [blocks_of(page)] for b, x in zip(found, features(found), strict=True)]
    return spark.createDataFrame(rows, "x array<double>, label double")


Tree = float | tuple  # a label, or (feature, threshold, below or equal, above)


def fit(spark: SparkSession) -> Tree:
    """The decision tree as nested tuples."""
    model = DecisionTreeClassifier(featuresCol="v", labelCol="label", maxDepth=6, minInstancesPerNode=1, maxBins=64, seed=1).fit(
        labelled(spark).coalesce(1).select(array_to_vector("x").alias("v"), "label"))

    def of(node) -> Tree:
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return node.split().featureIndex(), node.split().threshold(), of(node.leftChild()), of(node.rightChild())

    return of(model._java_obj.rootNode())


def classify(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Labels of all rows."""
    if isinstance(tree, float):
        return np.full(len(x), tree > 0.5)
    feature, threshold, low, high = tree
    return np.where(x[:, feature] <= threshold, classify(low, x), classify(high, x))


def main_text(page: str, tree: Tree) -> str:
    found = blocks_of(page)
    keep = classify(tree, features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null and empty pages, and pages without main text, give an empty text."""
    tree = fit(pages.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(p or "", tree) for p in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        return step

    read = columns_of(pages, page_id="long", url="string", html="string")
    return read.mapInArrow(over_batches(make), "page_id long, url string, text string, n_chars long")
