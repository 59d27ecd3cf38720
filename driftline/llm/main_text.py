"""Main text of web pages as the maximum-scoring contiguous region.

A page is a sequence of words and tags. A word's score follows from the elements it lies in, a tag's score is negative;
both are log-odds of being main text, counted on labelled pages. One scan finds the contiguous region of
greatest sum. What scores negative inside it (an advert or a form within an article) is left out; all else in it is kept.

Of the elements a word lies in, the nearest that tells something decides; boilerplate stays boilerplate down to its leaves.
An element is no boilerplate for its class alone if most of its words lie in one element of content, as a page's body of
class "has-sidebar" or a form around a whole page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages

#: A comment, an element without text, a tag with its attributes, or what else looks like a tag. No part runs past the next
#: "<" but the first two, which run to the end at most once, so that broken markup takes linear time.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^<>\"']*+(?:\"[^\"<]*\"[^<>\"']*+|'[^'<]*'[^<>\"']*+)*+)>|<[/!?a-zA-Z][^<>]*>",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same group ends.
_ENDS = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "cell", "th": "cell", "option": "option"}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A word in no element that tells anything; the range of log-odds; those from which an element counts as content, as boilerplate
#: (a section by its class, what is smaller by a class of nothing else).
PLAIN_WORD, CLIP, CONTENT, BOILERPLATE, SMALL_BOILERPLATE = 1.0, 3.0, 1.5, -1.15, -2.2
#: Least cost of a tag; added to counts.
TAG_COST, SMOOTHING = 0.2, 0.1
#: A class of these words first tells what an element has or stands in, not what it is (fixed values).
_OF_STATE = frozenset("has no not with without is in on js tag category cat type format hide show toggle hentry status".split())
#: Elements that are what their tag says, whatever stands in them; that never are boilerplate; that sections are made of (fixed values).
_ALWAYS, _NEVER, _SECTIONS = frozenset("nav footer aside".split()), frozenset("html body main".split()), frozenset("article section div form header ul ol table dl fieldset".split())
#: Elements that hold plain text (fixed values).
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6".split())


def _marks(attributes: str) -> list[list[str]]:
    """The words of each class, id and role."""
    out = []
    if "=" in attributes:
        for kind, *values in _MARKS.findall(attributes):
            for one in "".join(values).split():
                if kind.lower() == "role":
                    out.append([f"role {one.lower()}"])
                elif own := [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", one)]:
                    out.append(own)
    return out


def parsed(page: str) -> tuple[list[tuple[int, str, list]], list[tuple[str, int, list[str]]]]:
    """(elements, blocks). An element is (its parent, tag, marks), in page order, the first is the page itself. A block is (text,
    element that holds most of it, tags before it); blocks end at tags that aren't inline."""
    elements: list[tuple[int, str, list]] = [(0, "", [])]
    out: list[tuple[str, int, list[str]]] = []
    stack: list[tuple[str, str, int]] = []  # tag, group, element around
    count: Counter = Counter()
    own, parts, tags = 0, [], []

    def flush():
        nonlocal parts, tags
        if parts:
            words = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
            if words:
                out.append((words, max(parts, key=lambda x: len(x[0].strip()))[1], tags))
                tags = []
            parts = []

    def close(k: int):
        nonlocal own
        for _, group, _ in stack[k:]:
            count[group] -= 1
        own = stack[k][2]
        del stack[k:]

    def innermost(group: str) -> int:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == group)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], own))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        tag = name.lower()
        if tag not in _INLINE:
            flush()
            tags.append(tag)
        group = _ENDS.get(tag, tag)
        if m[2]:
            if count[group]:
                close(innermost(group))
            continue
        if tag in _ENDS and tag != "p" and count[group]:
            k = innermost(group)
            if not any(x[0] in ("ul", "ol", "table", "dl", "select") for x in stack[k:]):
                close(k)
        elif tag in _CLOSES_P and count["p"]:
            close(innermost("p"))
        if tag in _VOID or m[4].endswith("/") and tag in ("path", "use"):
            continue
        stack.append((tag, group, own))
        count[group] += 1
        elements.append((own, tag, _marks(m[4])))
        own = len(elements) - 1
    if at < len(page):
        parts.append((page[at:], own))
    flush()
    return elements, out


class Weights:
    """Log-odds of tags and of words of classes, and costs of tags."""

    def __init__(self, tags: dict[str, float], words: dict[str, float], costs: dict[str, float]):
        self.tags, self.words, self.costs = tags, words, costs

    def by_marks(self, marks: list[list[str]]) -> float:
        """Of the element's classes the one that tells most, each the mean of its words. Where boilerplate is named first, what
        follows only says which part of it ("comment-body")."""
        each = []
        for own in marks:
            if own[0] not in _OF_STATE:
                odds = [self.words.get(w, 0.0) for w in own]
                first = next((x for x in odds if x), 0.0)
                each.append(sum(min(x, 0.0) if first < 0 else x for x in odds) / len(odds))
        return max(each, key=lambda x: (abs(x), -x), default=0.0)

    def scores(self, elements: list[tuple[int, str, list]], sizes: list[int]) -> tuple[list[float], list[bool]]:
        """(what each element adds to the score of a word in it, whether it lies in content); sizes are words directly in each."""
        tag_odds = [self.tags.get(tag, 0.0) for _, tag, _ in elements]
        mark_odds = [self.by_marks(marks) if marks else 0.0 for _, _, marks in elements]
        is_content = [mark > BOILERPLATE and (tag in ("main", "article") or mark >= CONTENT) for (_, tag, _), mark in zip(elements, mark_odds, strict=True)]
        words, most = list(sizes), [0] * len(elements)  # words in each, and in the largest element of content below it
        for k in range(len(elements) - 1, 0, -1):
            parent = elements[k][0]
            words[parent] += words[k]
            most[parent] = max(most[parent], words[k] if is_content[k] else most[k])
        out, within = [0.0] * len(elements), [False] * len(elements)
        for k in range(1, len(elements)):
            parent, tag, _ = elements[k]
            own, odds = tag_odds[k], mark_odds[k]
            around = most[k] and 2 * most[k] >= words[k]
            if tag in _NEVER or tag not in _ALWAYS and around:
                own, odds = max(own, 0.0), max(odds, 0.0) if tag in _NEVER or odds > SMALL_BOILERPLATE else odds
            small = tag in _TEXTS or own >= CONTENT and tag not in _SECTIONS
            if tag == "header" and not within[parent] and not around:
                own = -CLIP  # the site's, as it neither lies in content nor holds it
            if odds <= (SMALL_BOILERPLATE if small else BOILERPLATE):
                own = odds
            elif own > BOILERPLATE:
                own = own + odds
            before = out[parent]
            out[k] = before if before <= BOILERPLATE else own if own <= BOILERPLATE else max(-1.0, min(CLIP, before + own))
            within[k] = within[parent] or is_content[k] and out[k] > BOILERPLATE
        return out, within

    def judged(self, page: str) -> list[tuple[str, float, float]]:
        """(text, score of all its words, cost of the tags before it) of each block. Boilerplate within content (an advert in an
        article) costs nothing: the element around it holds both sides together."""
        elements, found = parsed(page)
        sizes, n = [0] * len(elements), [text.count(" ") + 1 for text, _, _ in found]
        for (_, element, _), size in zip(found, n, strict=True):
            sizes[element] += size
        state, within = self.scores(elements, sizes)
        out = []
        for (text, element, tags), size in zip(found, n, strict=True):
            x = state[element]
            if x <= BOILERPLATE and within[element]:
                out.append((text, 0.0, 0.0))
            else:
                score = size * (min(PLAIN_WORD + x, -PLAIN_WORD) if x <= BOILERPLATE else max(PLAIN_WORD + x, 0.1 * PLAIN_WORD))
                out.append((text, score, sum(self.costs.get(t, TAG_COST) for t in tags)))
        return out


@lru_cache(maxsize=1)
def learned() -> Weights:
    """Weights from the labelled pages: by pages that have a tag, or a word of a class, in and out of main text; of tags' costs by
    blocks."""
    counts = {(kind, main): Counter() for kind in ("tag", "word", "block") for main in (True, False)}
    for page, labels in labelled_pages():
        elements, found = parsed(page)
        sides: dict[bool, set] = {True: set(), False: set()}
        for (_, element, _), main in zip(found, labels, strict=True):
            while element:
                sides[main].add(element)
                counts["block", main][elements[element][1]] += 1
                element = elements[element][0]
        for main, own in sides.items():
            own = own - sides[not main]  # an element around both tells nothing
            counts["tag", main].update({elements[k][1] for k in own} - {"html", "body"})
            counts["word", main].update({w for k in own for w in chain.from_iterable(elements[k][2])})

    def odds(kind: str) -> dict[str, float]:
        yes, no = counts[kind, True], counts[kind, False]
        least = lambda x: BOILERPLATE / 2 if kind == "tag" and yes[x] else -CLIP  # noqa: E731  a tag that content has is no boilerplate
        return {x: max(least(x), min(CLIP, math.log((yes[x] + SMOOTHING) / (no[x] + SMOOTHING)))) for x in {*yes, *no}}

    yes, no = counts["block", True], counts["block", False]
    return Weights(odds("tag"), odds("word"), {t: TAG_COST + math.log1p(no[t] / (yes[t] + 1)) for t in {*yes, *no}})


def best_region(blocks: list[tuple[float, float]]) -> tuple[int, int]:
    """(first, last + 1) of the contiguous blocks (score, cost of what lies before it) of the greatest sum over zero, costs before the
    first left out; of equal ones the one that ends first, then the shortest. (0, 0) if there is none."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for k, (score, cost) in enumerate(blocks):
        run -= cost
        if run <= 0:
            run, start = 0.0, k
        run += score
        if run > best:
            best, found = run, (start, k + 1)
    return found


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The page's main text, blocks joined by one space; empty for null, for no text and where no word scores."""
    found = (weights or learned()).judged(page or "")
    first, end = best_region([(score, cost) for _, score, cost in found])
    return " ".join(text for text, score, _ in found[first:end] if score > 0)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of pages.

    Null or empty html gives an empty text; a null page_id or url is carried; repeated rows are worked on each; other columns
    are ignored; an empty table gives no rows. Of regions of equal score the first is taken.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
