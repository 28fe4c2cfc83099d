"""Main-text extraction by the maximum-scoring run of a page's tokens.

A page is read as one sequence of word runs and tags.  Every word run scores its number of words
times the log-odds, for its open elements, of main text against page furniture (an element that is
all but never main text decides alone, whatever holds it); a run of furniture costs a few tags, whatever
its length, so that a long advert does not cut an article; every tag scores below zero.  One linear scan
finds the contiguous region of highest sum.  Inside it, runs whose own log-odds are below zero (an advert
between paragraphs) are left out.  A furniture word that is part of a class token counts only for boxes
with at most half of the page's words, and not beside a word of layout ("with-sidebar").

The weights of elements and class words are counted, with a symmetric prior, on labelled pages: the files
of ``labelled``, whose main text lies between marks.  They are counted on the driver and sent along.

Defined cases: null or empty html gives empty text; so does a page without a run that scores above
zero; cut-off pages are read as far as they go (an open tag, comment or script at the end is markup); a quote opens
a string only as an attribute's value, so that ``title=O'Brien`` ends with its tag;
pages of any length are read whole; equal sums keep the earliest, then the shortest region; repeated
rows give equal results; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

#: What stands in a tag: names, and after ``=`` a value, in which alone a quote opens a string.
_ATTRIBUTES = r"""(?:[\s/]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|[^\s/>=]++)*+"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_MARKED = frozenset(("class", "id", "role"))
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe select title head".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of these ends an open p; one of these ends an open element of its own name.
ENDS_P = BLOCK - {"br", "button", "label", "option"}
ENDS_OWN = frozenset("li dt dd tr td th option".split())
#: Elements that an end tag or an implied end does not reach out of.
WALL = frozenset("table td th article section aside nav header footer form main body".split())
STOP = WALL | {"ul", "ol", "div"}

#: Elements that hold an article, and elements of running text.
INSIDE, TEXT = frozenset(("article", "main")), frozenset("p h1 h2 h3 h4 h5 h6 td dd blockquote figcaption pre".split())
#: Marks of main text in labelled pages, and where these pages are.
MARKS = re.compile(r"<!--(/?)main-->")
LABELLED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labelled")
#: Words that make a class token tell of the page's layout, as "with-sidebar" or "comments-open" does.
LAYOUT_WORDS = frozenset("with without has have no not open opened closed enabled disabled".split())
#: Cost of a tag (a furniture run costs ten tags at most), pseudo-count of a label, log-odds of a word without
#: context (main text is the larger part of a page), and the log-odds below which one label decides.
TAG_COST, PRIOR, BASE, DECIDES = 0.1, 0.5, 0.6, -2.5
#: Bound of the log-odds of main text, attributes whose score is remembered, and their greatest length.
MOST, MEMO_TAGS, MEMO_LENGTH = 2.0, 65_536, 512


def _label(tag: str, inside: bool, in_text: bool) -> str:
    """An element's label: in an article, and a link in running text, it is another thing."""
    return "a in text" if tag == "a" and (inside or in_text) else f"{tag} in article" if inside else tag


class _Element:
    """An open element: what its own tag and attributes, and all open ones together, say."""

    __slots__ = ("tag", "total", "worst", "inside", "in_text", "box", "labels")

    def __init__(self, tag: str, top: "_Element | None" = None, own: float = BASE, box: int = 0, labels: frozenset[str] = frozenset()) -> None:
        self.tag, self.box, self.labels = tag, box, labels
        self.total, self.worst = (own, 0.0) if top is None else (top.total + own, min(top.worst, own))
        self.inside = top is not None and (top.inside or tag in INSIDE)
        self.in_text = top is not None and (tag in TEXT or top.in_text and tag not in BLOCK)

    def score(self) -> float:
        return self.worst if self.worst < DECIDES else self.total


class _Stack:
    """Open elements.  Places of each tag, and of what ends do not reach out of, are kept beside them, so
    an end tag costs no more than the elements that it ends."""

    def __init__(self, root: _Element) -> None:
        self.open, self.places = [root], {}
        self.walls: list[int] = []
        self.stops: list[int] = []

    def push(self, e: _Element) -> None:
        at = len(self.open)
        self.open.append(e)
        self.places.setdefault(e.tag, []).append(at)
        if e.tag in WALL:
            self.walls.append(at)
        if e.tag in STOP:
            self.stops.append(at)

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()
        for kept in (self.walls, self.stops):
            while kept and kept[-1] >= at:
                kept.pop()

    def end(self, tag: str) -> None:
        """An end tag: without an open element of its name in reach it ends nothing."""
        if (found := self.places.get(tag)) and (tag in WALL or not self.walls or self.walls[-1] < found[-1]):
            self._cut(found[-1])

    def start(self, tag: str) -> None:
        """What a start tag ends: an open p, or an open element of its own name."""
        at = max((self.places[x][-1] for x, ends in (("p", ENDS_P), (tag, ENDS_OWN)) if tag in ends and self.places.get(x)), default=0)
        if at and (not self.stops or self.stops[-1] <= at):
            self._cut(at)


class _Boxes:
    """Words of text in boxes that only a part of a class token marks as furniture."""

    def __init__(self) -> None:
        self.words, self.parent = [0], [-1]  # the first is the page

    def open(self, parent: int) -> int:
        self.words.append(0)
        self.parent.append(parent)
        return len(self.words) - 1

    def large(self) -> frozenset[int]:
        """Those with more than half of the page's words: no furniture."""
        held = list(self.words)
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        return frozenset(k for k in range(1, len(held)) if 2 * held[k] > held[0])


def _class_words(attributes: str) -> Iterator[list[str]]:
    """The words of each class token, id and role."""
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split() if m[1].lower() in _MARKED else ():
            yield list(map(str.lower, _PIECE.findall(token)))


def _walk(page: str, push: Callable[[str, str, _Element], _Element], note: Callable[[str], None] | None = None) -> Iterator[tuple[str | None, _Element, bool]]:
    """(text, innermost element, begins a block) for word runs; (None, ...) for tags; other markup is noted."""
    stack = _Stack(_Element(""))
    at, fresh, n = 0, True, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            yield text, stack.open[-1], fresh
            fresh = fresh and not text.strip()
        if not m:
            return
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if note:
                note(m[0])
            continue
        closing, attributes = m[1], m[3] or ""
        if tag in BLOCK:
            fresh = True
        yield None, stack.open[-1], fresh
        if closing:
            stack.end(tag)
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if tag != "head" else re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = n if not end else end.start() if page[end.start() + 1] != "/" else end.end()
        elif tag not in VOID:
            stack.start(tag)
            stack.push(push(tag, attributes, stack.open[-1]))


def labelled_pages() -> list[str]:
    names = sorted(x for x in os.listdir(LABELLED) if x.endswith(".html"))
    out = []
    for name in names:
        with open(os.path.join(LABELLED, name), encoding="utf-8") as f:
            out.append(f.read())
    return out


def labelled_runs(page: str) -> Iterator[tuple[str, bool, frozenset[str]]]:
    """(words, is main text, labels of the open elements) of a marked page."""
    main = [False]

    def note(markup: str) -> None:
        if m := MARKS.fullmatch(markup):
            main[0] = not m[1]

    def push(tag: str, attributes: str, top: _Element) -> _Element:
        own = frozenset(() if tag in ("html", "body") else (_label(tag, top.inside, top.in_text), *("." + w for ws in _class_words(attributes) for w in ws)))
        return _Element(tag, top, labels=top.labels | own)

    for text, element, _ in _walk(page, push, note):
        if text is not None:
            yield text, main[0], element.labels


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds of each label for main text, counted on marked pages; those for main text are bounded."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    words = [0, 0]
    for page in pages:
        for text, main, labels in labelled_runs(page):
            n = len(text.split())
            words[main] += n
            for label in labels:
                seen[main][label] += n
    odds = {x: math.log((seen[1][x] + PRIOR) / (words[1] + 2 * PRIOR)) - math.log((seen[0][x] + PRIOR) / (words[0] + 2 * PRIOR)) for x in seen[0] | seen[1]}
    return {x: min(v, MOST) for x, v in odds.items()}


@lru_cache(1)
def weights() -> dict[str, float]:
    """The weights of all labelled pages."""
    return learn(labelled_pages())


class Extractor:
    """Extracts main texts by given weights."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.memo: dict[tuple[str, str, bool, bool], tuple[float, float, bool]] = {}

    def __reduce__(self) -> tuple:
        return Extractor, (self.odds,)

    def _own(self, tag: str, attributes: str, inside: bool, in_text: bool) -> tuple[float, float, bool]:
        """Log-odds that one element adds, the same without furniture words that are part of a token, and
        whether there are such words; of several class words the most telling counts."""
        if tag in ("html", "body"):
            return 0.0, 0.0, False
        key = tag, attributes, inside, in_text
        if (found := self.memo.get(key)) is not None:
            return found
        odds = self.odds
        score = odds.get(_label(tag, inside, in_text), 0.0)
        exact: list[float] = []
        partial: list[float] = []
        for pieces in _class_words(attributes):
            layout = not LAYOUT_WORDS.isdisjoint(pieces)
            for own in (odds["." + p] for p in pieces if "." + p in odds):
                if own >= 0 or len(pieces) == 1:
                    exact.append(own)
                elif not layout:
                    partial.append(own)

        def with_marks(marks: list[float]) -> float:
            mark = max(marks, key=abs) if marks else 0.0
            return mark if mark < DECIDES else score + mark

        found = with_marks(exact + partial), with_marks(exact), bool(partial)
        if len(attributes) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_TAGS:
                self.memo.clear()
            self.memo[key] = found
        return found

    def _scored(self, page: str, boxes: _Boxes, large: frozenset[int]) -> list[tuple[str | None, float, bool]]:
        """(text, score of its context, begins a block) for word runs; (None, cost, ...) for tags.  Boxes of
        ``large`` are not judged by a part of a class token."""

        def push(tag: str, attributes: str, top: _Element) -> _Element:
            own, unmarked, partial = self._own(tag, attributes, top.inside, top.in_text)
            box = boxes.open(top.box) if partial else top.box
            return _Element(tag, top, unmarked if partial and box in large else own, box)

        out: list[tuple[str | None, float, bool]] = []
        for text, element, fresh in _walk(page, push):
            if text is None:
                out.append((None, -TAG_COST, fresh))
            else:
                boxes.words[element.box] += len(text.split())
                out.append((text, element.score(), fresh))
        return out

    def tokens(self, page: str) -> list[tuple[str | None, float, bool]]:
        boxes = _Boxes()
        runs = self._scored(page, boxes, frozenset())
        large = boxes.large()
        return self._scored(page, _Boxes(), large) if large else runs

    def text(self, page: str | None) -> str:
        """The main text: blocks in page order, white space inside a block as one space, joined by one space."""
        if not page:
            return ""
        runs = self.tokens(page)
        best, total, begin, region = 0.0, 0.0, 0, (0, 0)
        for i, (text, score, _) in enumerate(runs):
            if text is None or score <= 0:
                gain = -TAG_COST if text is None else 0.0 if text.isspace() else max(score, -10 * TAG_COST)
            else:
                gain = 0.0 if text.isspace() else score * len(text.split())
            if total <= 0:
                total, begin = 0.0, i
            total += gain
            if total > best:
                best, region = total, (begin, i + 1)
        blocks: list[list[str]] = [[]]
        for text, score, fresh in runs[region[0] : region[1]]:
            if fresh and blocks[-1]:
                blocks.append([])
            if text is not None and score > 0:
                blocks[-1].append(text)
        joined = (" ".join("".join(map(entities.unescape, b)).split()) for b in blocks)  # a reference does not reach over markup
        return " ".join(x for x in joined if x)


def extract_text(page: str | None) -> str:
    return Extractor(weights()).text(page)


def extract(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of its html in ``out`` (and without the html); one pass, no shuffle."""
    kept = [c for c in df.columns if c not in (html_col, out)]
    fed = df.select(*kept, F.col(html_col).cast("string").alias(html_col))
    sent = df.sparkSession.sparkContext.broadcast(Extractor(weights()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = sent.value
        for whole in batches:
            for batch in slices(whole, len(kept)):
                texts = [extractor.text(x) for x in batch.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, out])

    return fed.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType())]))
