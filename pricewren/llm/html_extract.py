"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive, tags negative, and a linear scan finds the contiguous run of
tokens with the greatest sum: the content region. The weights are log ratios of how often a token occurs inside and outside
the content of labelled pages; pages whose markup names its content (one article or main element) label themselves.
Counting is a Spark aggregation over a sample bounded by max_pages in expectation; the driver receives one row per known
tag name.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments score as tags do and are never part of
the text; they are known by fixed element names, and by whole class names, ids or roles (`ad`, not a part of `no-ad`). These never mark html,
body, article, main or an element that holds an article or main; only comments stay marked if they hold others than the page's first.
The region is widened to whole blocks, and to the outermost article or main element that holds it, with all that is inside. Character references are decoded once; white space inside a block is one space; blocks
are joined by line feeds.

Rows are independent: no shuffle, one page at a time, in time linear in its length, however its tags are nested or left open. A null or empty page has the empty text; so has a page without
words. Of equal runs the first counts. Unclosed and stray tags are tolerated; an unclosed comment or script runs to the end of the page. Repeated rows each
get their text. Empty tables give empty results; without labelled pages fixed default weights hold.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewren.llm.common import map_slices

#: Fixed names of HTML: elements without content, elements that are blocks, elements whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math noframes xmp".split())
#: Fixed elements, roles and class words of what is not content.
ASIDE = frozenset("nav header footer aside form menu dialog button select head object audio video canvas".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header footer"
    " sidebar cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related comment comments"
    " reply replies respond discussion disqus contentinfo complementary search form login pagination".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
#: Fixed weights where no page is labelled.
DEFAULT_WORD, DEFAULT_TAG = 0.5, -3.0
#: A tag scores this much at most, a word this much at least.
MOST_TAG, LEAST_WORD = -0.05, 0.05

#: Elements that an inline end tag inside them does not close.
WALLS = frozenset("article main body td li div".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LONG_NUMBER = re.compile("&#[0-9]{1000}")
_NAMES = sorted(VOID | BLOCKS | RAW | ASIDE | set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split()))


def tokens(html: str) -> list[tuple]:
    """The page as (kind, value, block, aside, content): kind is `word` (value: the text of a run) or a tag name.

    block numbers the blocks of the page, aside tells what is inside an element that is not content, content has the numbers of the
    outermost and the innermost article or main element around (empty: none). A quote that nothing closes is a character like others.
    """
    out: list[tuple] = []
    stack: list[tuple[str, bool, tuple, int]] = []  # name, aside by elements, content, innermost element marked by its names (0: none)
    depths: dict[str, list[int]] = {}  # by name: where in the stack it is open
    blocks: list[int] = []  # where blocks are open
    walls: list[int] = []  # where elements are open that no inline end tag reaches over
    marks: list[tuple[int, bool]] = [(0, False)]  # of each marked element: the one around it, whether it is comments
    held: set[int] = {0}  # marked elements that hold content
    passed: set[int] = set()  # marked elements that a content element has been looked for around
    block = made = at = 0
    end, outside = len(html), (False, (), 0)

    def text(begin: int, stop: int) -> None:
        if begin < stop:
            out.append(("word", _decoded(html[begin:stop]), block, *(stack[-1][1:] if stack else outside)))

    def cut(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()[0]
            depths[gone].pop()
            for places in (blocks, walls):
                if places and places[-1] == len(stack):
                    places.pop()

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3]
        known, (aside, content, mark) = name if name in _KNOWN else "other", stack[-1][1:] if stack else outside
        if m[1]:
            open_at = depths.get(name)
            if open_at and (name in BLOCKS or not walls or walls[-1] <= open_at[-1]):
                cut(open_at[-1])
            aside, content, mark = stack[-1][1:] if stack else outside
            if name in BLOCKS:
                block += 1
            out.append((known, "", block, aside, content, mark))
            continue
        if name in BLOCKS:
            block += 1
            if stack and stack[-1][0] == "p" or name == "p":  # a block ends a paragraph, and inline elements left open in it
                if blocks and stack[blocks[-1]][0] == "p":
                    cut(blocks[-1])
            elif name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                cut(len(stack) - 1)
            aside, content, mark = stack[-1][1:] if stack else outside
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            out.append((known, "", block, True, content, mark))
            continue
        aside = aside or name in ASIDE
        if name in ("article", "main"):
            made += 1
            content = (content[0] if content else made, made)
            around = mark
            while around not in held and around not in passed:
                passed.add(around)
                outer, comments = marks[around]
                if made == 1 or not comments:
                    held.add(around)
                around = outer
        elif name not in ("html", "body") and (words := _aside_words(attributes)):
            marks.append((mark, not words.isdisjoint(COMMENT_WORDS)))
            mark = len(marks) - 1
        out.append((known, "", block, aside, content, mark))
        if name == "br":
            out.append(("word", " ", block, aside, content, mark))
        if name not in VOID and not attributes.endswith("/"):
            depths.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            if name in WALLS:
                walls.append(len(stack))
            stack.append((name, aside, content, mark))
    out_of = [False]  # by mark: whether the element or one around it is not content
    for number, (outer, _) in enumerate(marks[1:], 1):
        out_of.append(number not in held or out_of[outer])
    return [(kind, value, block, aside or out_of[mark], content) for kind, value, block, aside, content, mark in out]


_KNOWN = frozenset(_NAMES)


def _decoded(run: str) -> str:
    """Character references decoded; numbers of any length."""
    if _LONG_NUMBER.search(run):
        run = re.sub("&#0+(?=[0-9])", "&#", run)
        run = re.sub("&#[0-9]{8,};?", "\ufffd", run)
    return entities.unescape(run)


def _aside_words(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {w for m in _NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()} & ASIDE_WORDS


def _labels(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Token counts inside and outside the content of self-labelled pages."""
    counts: dict[str, list[int]] = {}
    for page in batch.column("html").to_pylist():
        found = tokens(page)
        if max((t[4][-1] for t in found if t[4]), default=0) != 1:
            continue
        for kind, value, _, aside, content in found:
            n = len(value.split()) if kind == "word" else 1
            counts.setdefault(kind, [0, 0])[0 if content and not aside else 1] += n
    kinds = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array([counts[k][0] for k in kinds], pa.int64()), pa.array([counts[k][1] for k in kinds], pa.int64())],
        names=["kind", "inside", "outside"],
    )


def fit(pages: DataFrame, max_pages: int = 4000, html: str = "html", keys: tuple[str, ...] = ()) -> dict[str, float]:
    """Weights by token kind from the self-labelled pages of a sample, drawn by keys and html.

    Name the keys of the rows, so that copies of a page are not drawn all or none.
    """
    rows = pages.select(F.xxhash64(*keys, html).alias("draw"), F.col(html).alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
    rate = min(1.0, max_pages / max(1, rows.count()))
    chosen = rows.where(F.pmod("draw", F.lit(1 << 20)) < rate * (1 << 20)).select("html")
    counts = map_slices(chosen, _labels, "kind string, inside long, outside long", "html").groupBy("kind").agg(F.sum("inside"), F.sum("outside"))
    counts = {kind: (a, b) for kind, a, b in counts.collect()}  # one row per known name at most
    if "word" not in counts:
        return {}
    inside, outside = (sum(c[k] for c in counts.values()) + len(_KNOWN) for k in (0, 1))
    ratio = lambda c: math.log((c[0] + 1) / inside) - math.log((c[1] + 1) / outside)
    weights = {kind: min(MOST_TAG, ratio(counts.get(kind, (0, 0)))) for kind in _KNOWN | {"other"}}
    return weights | {"word": max(LEAST_WORD, ratio(counts["word"]))}


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """First and last index of the run with the greatest positive sum; the first such run."""
    best, total, begin, found = 0.0, 0.0, 0, None
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i)
    return found


def extract_text(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page."""
    if not page:
        return ""
    found = tokens(page)
    word, tag = weights.get("word", DEFAULT_WORD), lambda kind: weights.get(kind, DEFAULT_TAG)
    scores = []
    for kind, value, _, aside, _ in found:
        if kind != "word":
            scores.append(tag(kind))
        else:
            n = len(value.split())
            scores.append((-1 if aside else 1) * word * n)
    run = best_run(scores)
    if run is None:
        return ""
    begin, last = run
    holder = _holder(found, begin, last)
    if holder:
        inside = [t for t in found if holder in t[4]]
    else:
        first_block, last_block = found[begin][2], found[last][2]
        inside = [t for t in found if first_block <= t[2] <= last_block]
    blocks: dict[int, list[str]] = {}
    for kind, value, block, aside, _ in inside:
        if kind == "word" and not aside:
            blocks.setdefault(block, []).append(value)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(t for t in texts if t)


def _holder(found: list[tuple], begin: int, last: int) -> int:
    """The outermost content element with more than half of the run's words, else 0."""
    counts: dict[tuple, int] = {}
    for kind, value, _, aside, content in found[begin : last + 1]:
        if kind == "word" and not aside:
            outermost = content[:1]
            counts[outermost] = counts.get(outermost, 0) + len(value.split())
    holder = max(counts, key=lambda k: counts[k], default=())
    return holder[0] if holder and 2 * counts[holder] > sum(counts.values()) else 0


def extract(pages: DataFrame, weights: dict[str, float], keys: list[str], html: str = "html") -> DataFrame:
    """keys and text of every page."""
    rows = pages.select(*[F.col(k) for k in keys], F.col(html).alias("__html"))
    fields = "".join(f"`{k}` {t}, " for k, t in rows.dtypes[:-1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract_text(x, weights) for x in batch.column("__html").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keys, "text"])

    return map_slices(rows, run, f"{fields}text string", "__html")
