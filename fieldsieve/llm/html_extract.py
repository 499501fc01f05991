"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier gives each block
its odds of being content; the costs of either label are capacities from the source and to the
sink. Neighbours in page order, and next blocks of one container, are tied by smoothness
capacities. The source's side of a minimum cut is the content.

The classifier sees a block's text (length, share of links, end of a sentence, heading), the blocks
beside it, and what elements and names say of it. Its weights are fitted by penalised logistic
regression on the blocks of some `SAMPLE` pages that have an article or main element: what lies in it
is content, what lies outside is not, and blocks that are marked both ways are left out. The text's
weights are fitted by themselves, so that they can tell where marks are wanting, those of marks given the
text's odds (data that never speak against a mark leave it near its prior or below). The weight of standing in such an element, which labels the blocks, is the log ratio of how often content and other
blocks by the rest of the evidence stand there, but no less than in `WEIGHTS`. With fewer than `LEAST_BLOCKS` labelled blocks of
either kind `WEIGHTS` stand; they are the prior of the fit as well.

A name speaks for its block by its last word, words of mere shape left aside: "user-comments-list" are
comments, "copyright-law" is not a copyright notice. An id must consist of such words as a whole, and
ids of paragraphs and headings are anchors, which say nothing.

Defined results
- null or empty html, or none but boilerplate: empty text. Null page_id or url: kept as it is.
- a tag that the page's end cuts off is dropped; unclosed and stray tags are tolerated.
- `br` counts as white space; white space is Unicode's, so no-break spaces are one as well.
- head is no element of its own, as its end may be left out: what it may hold is skipped one by one.
- scripts, styles, templates, form controls and comments in the markup are never text.
- ties: a block that either side of the cut could take is boilerplate.
- further columns don't matter here, whatever their names; an empty table: no rows.
- very long pages: blocks and work grow with their length. Repeated rows: each its own row.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_BROKEN = re.compile(r"<[a-zA-Z/!?][^<]*\Z", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Before a name in a token they say that it is elsewhere: "has-sidebar".
_ELSEWHERE = frozenset("has with no without".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Their insides are not text of the page.
SKIPPED = frozenset("script style noscript template svg math title iframe object canvas audio video textarea select option datalist button".split())
#: Of these, those without end tag run to the page's end; others without one are as if they weren't there.
RAW = frozenset("script style noscript template title iframe textarea".split())
#: Start tags end these open elements, as far up as the container they are in. A block's start ends a paragraph.
CLOSED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody", "tfoot"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in SKIPPED}
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table figure blockquote details dialog menu fieldset".split())
MAIN_TAGS, SIDE_TAGS = frozenset(["article", "main"]), frozenset("nav footer aside form menu dialog fieldset".split())
MAIN_NAMES = frozenset("article main content post entry story body text".split())
SIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr cc notice notification alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search form comment comments discussion replies responses disqus pagination pager toolbar copyright legal disclaimer skip complementary contentinfo dialog".split())
#: Words of names that tell the shape or place of a thing and not what it is.
SHAPES = MAIN_NAMES | frozenset("area articles bar block bottom box button buttons col column container fixed global group holder icon icons inline inner item items left link links list lists main new outer page pane panel posts primary reader right row secondary section sections site slot small sticky strip this thread top unit user users window wrap wrapper zone".split())
#: Not beside the content when they stand in it.
OWN_HEADER = frozenset(["header", "masthead"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: The classifier's features; the first seven are the text's, and `main` is to be the last.
FEATURES = ("constant", "words", "links", "sentence", "heading", "near_links", "near_words", "side_tag", "side_name", "partly", "header", "main")
TEXT_FEATURES = 7
#: Weights where none can be fitted.
WEIGHTS = (-1.5, 0.8, -4.0, 1.0, 0.5, -0.5, 0.1, -8.0, -8.0, -1.0, -4.0, 3.0)
#: Inside the content links, its own and those beside it, count for less: an article has lists of links.
LINKS_IN_MAIN = 0.4
#: A text alone is never surer than these odds, however long it is.
MOST_OF_TEXT = 2.0
#: Pages that the weights are fitted on (about; taken by a hash), and the fewest blocks of either kind.
SAMPLE, LEAST_BLOCKS = 2000, 200
MOST_ODDS = 8.0
#: Smoothness: neighbours in one container, neighbours apart, and next blocks of one container.
NEAR, APART, SIBLING = 0.6, 0.15, 0.3


@dataclass(frozen=True)
class Marks:
    """What the elements around a block say of it."""

    article: bool = False
    main: bool = False
    side_tag: bool = False
    side_name: bool = False
    partly: bool = False
    header: bool = False

    @property
    def side(self) -> bool:
        return self.side_tag or self.side_name


@dataclass
class Block:
    container: int
    marks: Marks
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0

    @property
    def links(self) -> float:
        return min(1.0, self.linked / max(1, len(self.text)))


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    """The features of a page's blocks, in the order of `FEATURES`."""
    out = []
    for i, b in enumerate(blocks):
        beside, m = blocks[max(0, i - 1) : i] + blocks[i + 1 : i + 2], b.marks
        near = (sum(x.links for x in beside) / 2, math.log1p(sum(x.words for x in beside) / 2))
        text = (1.0, math.log1p(b.words), b.links, float(b.text[-1] in ".!?…:;\"'»”"), float(b.heading))
        out.append((*text, *near, float(m.side_tag), float(m.side_name), float(m.partly and not m.main), float(m.header and not m.main), float(m.main and not m.side)))
    return out


def odds_of(x: tuple[float, ...], weights: tuple[float, ...] = WEIGHTS) -> float:
    """The log odds that a block is content."""
    text = sum(w * v for w, v in zip(weights[:TEXT_FEATURES], x[:TEXT_FEATURES], strict=True))
    text -= x[-1] * (1 - LINKS_IN_MAIN) * (weights[2] * x[2] + weights[5] * x[5])
    marks = sum(w * v for w, v in zip(weights[TEXT_FEATURES:], x[TEXT_FEATURES:], strict=True))
    return max(-MOST_ODDS, min(MOST_ODDS, max(-MOST_OF_TEXT, min(MOST_OF_TEXT, text)) + marks))


def _parts(word: str) -> list[str]:
    """A word of a name, in two if it is one of SIDE_NAMES and a shape run together."""
    if word not in SIDE_NAMES:
        for i in range(2, len(word) - 1):
            if word[:i] in SIDE_NAMES and word[i:] in SHAPES:
                return [word[:i], word[i:]]
    return [word]


def _named(attributes: str, within: bool, anchor: bool) -> tuple[bool, bool, bool]:
    """Whether an element's names say that it is content, beside it, or hold a word that could mean so.

    within: it stands in content; anchor: it is a paragraph or heading, whose ids only mark a place.
    """
    names = tuple((kind.lower(), "".join(values).lower()) for kind, *values in _NAMES.findall(attributes) if not (anchor and kind.lower() == "id"))
    if not names:
        return False, False, False
    short = sum(len(value) for _, value in names) <= 200
    return (_judged if short else _judged.__wrapped__)(names, within)


@lru_cache(maxsize=20_000)
def _judged(names: tuple[tuple[str, str], ...], within: bool) -> tuple[bool, bool, bool]:
    """`_named` of (attribute, value)s; short ones are remembered."""
    main = side = plain = partly = False
    for kind, value in names:
        for token in [value] if kind == "aria-label" else value.split():
            words = [p for w in _WORD.findall(token) for p in _parts(w)]
            beside = [w in SIDE_NAMES and before not in _ELSEWHERE and not (within and w in OWN_HEADER) for before, w in zip(["", *words], words)]
            telling = [own for own, w in zip(beside, words) if own or (w not in SHAPES and len(w) > 2)]
            whole = bool(telling) and (all(telling) if kind in ("id", "aria-label") else telling[-1])
            side, plain = side or whole, plain or (whole and len(words) == 1)
            partly = partly or (any(beside) and not whole)
            main = main or not any(beside) and not MAIN_NAMES.isdisjoint(words) and _ELSEWHERE.isdisjoint(words)
    return main and not plain, plain or (side and not main), partly


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, Marks]] = [("", 0, Marks())]
    number, in_link, heading, now = 0, 0, False, None
    at, endless = 0, set()

    def text(piece: str) -> None:
        nonlocal now
        if not piece:
            return
        if now is None:
            if piece.isspace():
                return
            _, container, marks = stack[-1]
            now = Block(container, marks, heading)
        now.parts.append(html.unescape(piece) if "&" in piece else piece)
        now.linked += len(piece) if in_link else 0

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                now.words = now.text.count(" ") + 1
                out.append(now)
            now = None

    def end(names: set[str]) -> None:
        """Open elements of these names go, up to the container around."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CONTAINERS:
                break
            if stack[i][0] in names:
                del stack[i:]

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, ending = name.lower(), bool(m[1])
        if name in SKIPPED:
            if ending or m[3].endswith("/") or name in endless:
                continue
            if past := _END[name].search(page, at):
                at = past.end()
            elif name in RAW:
                at = len(page)
            else:
                endless.add(name)
            continue
        if name == "a":
            in_link = 0 if ending else 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in INLINE:
            continue
        close()
        heading = name in HEADINGS and not ending
        if name in VOID or name in ("html", "head", "body"):
            continue
        if ending and name not in CONTAINERS:
            end({name})
            continue
        if not ending:
            end({"p"} | CLOSED.get(name, set()))
        in_link = 0 if name in CONTAINERS else in_link
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        _, container, marks = stack[-1]
        main, side, partly = _named(m[3], marks.main, name == "p" or heading) if m[3] else (False, False, False)
        article, aside = name in MAIN_TAGS, name in SIDE_TAGS
        if article or aside:  # whatever its names are
            main, side, partly = article, False, False
        if name in CONTAINERS:
            number, container = number + 1, number + 1
        elif not (main or side or partly):
            continue
        own = Marks(
            marks.article or article,
            marks.main or (main and not side),
            marks.side_tag or aside,
            marks.side_name or side,
            marks.partly or partly,
            marks.header or (name == "header" and not marks.main),
        )
        stack.append((name, container, own))
    rest = page[at:]
    text(rest[: m.start()] if (m := _BROKEN.search(rest)) else rest)
    close()
    return out


def cut_labels(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; odds: source capacity less sink capacity."""
    left = list(odds)  # what the source can still send (over 0) or the sink still take (under 0)
    near: list[dict[int, float]] = [{} for _ in odds]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    for start in range(len(left)):
        while left[start] > 1e-12:
            came, queue, end = {start: start}, deque([start]), -1
            while queue and end < 0:
                i = queue.popleft()
                for j, c in near[i].items():
                    if c > 1e-12 and j not in came:
                        came[j] = i
                        if left[j] < -1e-12:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                break
            path, j = [], end
            while j != start:
                path.append((came[j], j))
                j = came[j]
            flow = min(left[start], -left[end], *[near[i][j] for i, j in path])
            left[start] -= flow
            left[end] += flow
            for i, j in path:
                near[i][j] -= flow
                near[j][i] += flow
    inside = [x > 1e-12 for x in left]
    queue = deque(i for i, x in enumerate(inside) if x)
    while queue:
        for j, c in near[i := queue.popleft()].items():
            if c > 1e-12 and not inside[j]:
                inside[j] = True
                queue.append(j)
    return inside


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The content blocks of a page, joined by line feeds."""
    blocks = blocks_of(page) if page else []
    last: dict[int, int] = {}
    edges = []
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR if blocks[i - 1].container == b.container else APART))
        if b.container in last and last[b.container] < i - 1:
            edges.append((last[b.container], i, SIBLING))
        last[b.container] = i
    labels = cut_labels([odds_of(x, weights) for x in features_of(blocks)], edges)
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def labelled(page: str | None) -> list[tuple[float, ...]]:
    """The blocks that a page's article or main element labels: features but for `main`, rounded, and the label."""
    blocks = blocks_of(page) if page else []
    if not any(b.marks.article and not b.marks.side for b in blocks):
        return []
    rows = []
    for b, x in zip(blocks, features_of(blocks), strict=True):
        if b.marks.side if b.marks.article else b.marks.main:
            continue
        rows.append((1.0, round(x[1], 1), round(x[2], 1), x[3], x[4], round(x[5] * 4) / 4, float(round(x[6])), *x[7:-1], float(b.marks.article)))
    return rows


def _logistic(x: np.ndarray, label: np.ndarray, count: np.ndarray, prior: np.ndarray, given: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights by Newton's steps, each shortened until it helps; given: odds that are there without them."""

    def loss(w: np.ndarray) -> float:
        z = given + x @ w
        return float(count @ (np.logaddexp(0, z) - label * z) + ((w - prior) ** 2).sum() / 2)

    w = prior
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(given + x @ w, -30, 30)))
        slope = x.T @ (count * (label - p)) - (w - prior)
        step = np.linalg.solve(x.T @ (x * (count * p * (1 - p))[:, None]) + np.eye(len(w)), slope)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fitted(cells: list[tuple[float, ...]]) -> tuple[float, ...]:
    """Weights from counted cells (a row of `labelled`, blocks): the text's, then those of marks given the text's odds."""
    n = len(FEATURES)
    data = np.array(cells, float).reshape(-1, n + 1)
    texts, marks, label, count = data[:, :TEXT_FEATURES], data[:, TEXT_FEATURES : n - 1], data[:, n - 1], data[:, n]
    if min(count[label > 0].sum(), count[label == 0].sum()) < LEAST_BLOCKS:
        return WEIGHTS
    own = _logistic(texts, label, count, np.array(WEIGHTS[:TEXT_FEATURES]))
    said = _logistic(marks, label, count, np.array(WEIGHTS[TEXT_FEATURES:-1]), np.clip(texts @ own, -MOST_OF_TEXT, MOST_OF_TEXT))
    content = count / (1 + np.exp(-np.clip(texts @ own + marks @ said, -MOST_ODDS, MOST_ODDS)))
    other = count - content
    within, beside = (content @ label + 1) / (content.sum() + 2), (other @ label + 1) / (other.sum() + 2)
    return (*map(float, own), *map(float, said), max(WEIGHTS[-1], math.log(within / beside)))


def weights_of(pages: DataFrame, sample: int = SAMPLE) -> tuple[float, ...]:
    """The classifier's weights for these pages."""
    share = 1_000_000 * sample // max(1, sample, pages.count())
    some = pages.select("html", F.xxhash64("page_id", "url").alias("h")).where(F.col("html").isNotNull() & (F.pmod("h", F.lit(1_000_000)) < share))
    names = [*FEATURES[:-1], "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for page in batch.column("html") for row in labelled(page.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names)

    cells = some.select("html").mapInArrow(run, ", ".join(f"{n} double" for n in names)).groupBy(*names).agg(F.count("*").alias("n"))
    return fitted([tuple(r) for r in cells.orderBy(*cells.columns).collect()])  # as many cells as there are steps, whatever the pages


def extracted(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each of pages; weights: those of the classifier, fitted on pages if not given."""
    weights = weights_of(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
