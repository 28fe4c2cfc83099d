"""Finding the treatment of a name in the texts of its volume, and the colour said of its flowers.

An automaton over a volume's epithets finds every mention in one scan of the text, however many names there
are.  Texts are cut into chunks that overlap by the longest name and a window, so that each mention is judged
whole, and in one chunk only.  Names and chunks meet in cells of bounded size: a chunk group of a volume
with a block of its names.  A cell returns the best window of each name; the best of all cells is kept.

A mention is a name's genus, or its first letter with or without a full stop, then white space, then the
epithet, as whole words in any letter case; mentions may overlap.  Its window goes on to the next numbered
heading, figure or running title, and ``LOCATE_WINDOW`` characters at most.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terms of the locator and of the colour finder.
ORGANS = r"\b(flowers?|florets?|corollas?|petals?|perianth|calyx|sepals?|tepals?)\b"
COLOURS = r"\b(white|yellow|red|pink|purple|blue|greenish|orange|violet|crimson|scarlet|lilac|mauve|rose|cream|magenta|maroon|golden|whitish|yellowish|reddish|purplish|bluish|pinkish)\b"
APPENDAGES = r"\b(hairs?|hairy|pappus|filaments?|margins?|margined|scarious|ciliate|pubescen(t|ce)|tomentose|villous|puberulous|stellate|bristles?|anthers?|styles?|stigmas?|glands?|scales?|veins?|midribs?)\b"
MORPH = r"\b(herbs?|shrubs?|trees?|leaves|leaflets?|stems?|branch(es|lets)?|petioles?|lamina|inflorescences?|racemes?|panicles?|spikes?|umbels?|cymes?|bracts?|ovary|stamens?|capsules?|seeds?|fruits?|glabrous|pubescent|erect|ovate|lanceolate|oblong|elliptic|acute|obtuse)\b"
BOUNDARY = r"(\n\s*\d{1,3}\s*\.\s+[A-Z][a-z]{2,}\s+[a-z]{3,})|(\bFig\s*\.?\s*\d+)|(\n\s*[A-Z]{4,}(?:\s+[A-Z]{4,})*\s*\n)"
LOCATE_WINDOW, LEAST_TERMS, INDEX_HEAD, INDEX_SHARE, ORGAN_REACH, APPENDAGE_REACH = 2200, 3, 400, 0.22, 70, 40

#: The shortest text that each part of the boundary can match, so that its earliest end is known; white space
#: wider than a window cannot lie in one.
_SPACE = r"\s{0,2200}"
_BOUNDARIES = tuple(re.compile(f"(?=({p}))") for p in (rf"\n{_SPACE}\d{{1,3}}{_SPACE}\.\s{_SPACE}[A-Z][a-z]{{2,}}\s{_SPACE}[a-z]{{3}}", rf"\bFig{_SPACE}\.?{_SPACE}\d", rf"\n{_SPACE}[A-Z]{{4,}}(?:\s{_SPACE}[A-Z]{{4,}})*?{_SPACE}?\n"))
_TERM, _COLOUR, _ORGAN, _APPENDAGE = (re.compile(p, re.I) for p in (MORPH, COLOURS, ORGANS, APPENDAGES))
#: White space that may stand between genus and epithet.
WIDEST_GAP = 400
#: Characters of a chunk and of a cell's chunks, and names of a cell.
CHUNK, CELL_CHARS, CELL_NAMES = 1 << 19, 1 << 22, 20_000
#: Volumes up to which their sizes go to all tasks.
FEW_VOLUMES = 10_000


def folded(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Names:
    """The names of a volume as an automaton over their epithets."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        import ahocorasick

        by_epithet: dict[str, tuple[dict[str, list[int]], dict[str, list[int]]]] = {}
        for k, (genus, epithet) in enumerate(names):
            if genus and epithet:
                whole, initial = by_epithet.setdefault(folded(epithet), ({}, {}))
                whole.setdefault(folded(genus), []).append(k)
                initial.setdefault(folded(genus[0]), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for epithet, entry in by_epithet.items():
            # Genera of one word are looked up; any others are tried one by one.
            odd = [g for g in entry[0] if not all(map(_is_word, g))]
            self.automaton.add_word(epithet, (len(epithet), *entry, odd))
        if by_epithet:
            self.automaton.make_automaton()
        self.any = bool(by_epithet)

    def mentions(self, low: str, start: int, end: int) -> Iterator[tuple[int, list[int]]]:
        """(end of the mention, names mentioned) of mentions that end behind ``start``, up to ``end``."""
        if not self.any:
            return
        n = len(low)
        edge = lambda k: k == 0 or k == n or _is_word(low[k - 1]) != _is_word(low[k])
        for last, (size, whole, initial, odd) in self.automaton.iter(low):
            at, stop = last + 1 - size, last + 1
            if not start < stop <= end or not at or not low[at - 1].isspace():
                continue
            if (stop == n and not _is_word(low[stop - 1])) or not edge(stop):
                continue
            k = at
            while k and at - k < WIDEST_GAP and low[k - 1].isspace():
                k -= 1
            found: list[int] = []
            word = k
            while word and _is_word(low[word - 1]):
                word -= 1
            found += whole.get(low[word:k], ())
            found += [x for g in odd if low.endswith(g, 0, k) and (k - len(g) == 0 and _is_word(g[0]) or k > len(g) and edge(k - len(g))) for x in whole[g]]
            letter = k - (2 if k > 1 and low[k - 1] == "." and low[k - 2] in initial else 1)
            if k and low[letter] in initial and (letter == 0 and _is_word(low[0]) or letter > 0 and edge(letter)):
                found += initial[low[letter]]
            if found:
                yield stop, sorted(set(found))


class Places:
    """Where in a text its windows end, where its terms stand, and how many digits precede each place."""

    def __init__(self, text: str) -> None:
        self.text = text
        digit = np.fromiter(map(str.isdigit, text), np.int64, len(text))
        self.digits = np.concatenate([[0], np.cumsum(digit)])
        found = sorted((m.start(), m.end(1)) for p in _BOUNDARIES for m in p.finditer(text))
        self.starts, self.ends = [s for s, _ in found], [e for _, e in found]
        terms = [(m.start(), m.end(), m.group().lower()) for m in _TERM.finditer(text)]
        self.term_starts, self.term_ends, self.terms = ([t[k] for t in terms] for k in range(3))

    def window_end(self, begin: int) -> int:
        limit = min(len(self.text), begin + LOCATE_WINDOW)
        for k in range(bisect_left(self.starts, begin), len(self.starts)):
            if self.starts[k] >= limit:
                break
            if self.ends[k] <= limit:
                return self.starts[k]
        return limit

    def score(self, begin: int, end: int) -> int:
        """Distinct terms of a window; none if it reads as an index."""
        head = min(end - begin, INDEX_HEAD)
        if not head or self.digits[begin + head] - self.digits[begin] > INDEX_SHARE * head:
            return 0
        a, b = bisect_left(self.term_starts, begin), bisect_left(self.term_ends, end + 1)
        said = set(self.terms[a:b])
        if end < len(self.text) and _is_word(self.text[end - 1]) and _is_word(self.text[end]):
            # The window's length cuts a word: what is left of it may be a term, too.
            word = end
            while word > begin and _is_word(self.text[word - 1]):
                word -= 1
            if m := _TERM.fullmatch(self.text[word:end]):
                said.add(m.group().lower())
        return len(said)


def colour_on_organ(window: str | None) -> str | None:
    """The first colour with a floral organ within 70 characters and no appendage within 40, by their places."""
    text = window or ""
    places = {}
    for name, pattern in (("organ", _ORGAN), ("appendage", _APPENDAGE)):
        places[name] = [(m.start(), m.end()) for m in pattern.finditer(text)]

    def within(name: str, low: int, high: int) -> bool:
        return any(low <= s and e <= high for s, e in places[name])

    for m in _COLOUR.finditer(text):
        if within("organ", m.start() - ORGAN_REACH, m.end() + ORGAN_REACH) and not within("appendage", m.start() - APPENDAGE_REACH, m.end() + APPENDAGE_REACH):
            return m.group().lower()
    return None


def best_windows(names: Names, text: str, start: int, end: int) -> dict[int, tuple[int, int, int]]:
    """For each name the (terms, begin, end) of its best window, the first of equals, among mentions that end
    behind ``start``, up to ``end``."""
    places, judged, best = None, {}, {}
    for stop, found in names.mentions(folded(text), start, end):
        places = places or Places(text)
        if stop not in judged:
            close = places.window_end(stop)
            judged[stop] = (places.score(stop, close), close)
        score, close = judged[stop]
        for k in found:
            if score >= LEAST_TERMS and (k not in best or (-score, stop) < (-best[k][0], best[k][1])):
                best[k] = (score, stop, close)
    return best


def locate(text: str | None, genus: str | None, epithet: str | None) -> str | None:
    """The window after a mention of one name that reads most like a treatment, the first of equals."""
    best = best_windows(Names([(genus or "", epithet or "")]), text or "", -1, len(text or ""))
    return text[best[0][1] : best[0][2]] if best else None


_FOUND = "volume string, genus string, epithet string, terms int, part string, begin long, window string"


def locate_treatments(names: DataFrame, volumes: DataFrame, volume: str, text: str, genus: str, epithet: str, part: str | None = None) -> DataFrame:
    """Names with window, colour and recovery status; each name is looked for in all texts of its volume.

    A volume may have several texts, each read on its own; of equal windows the one of the smallest
    ``part`` counts (without that column, of the smallest text hash), then the first.  A name without
    genus, epithet or volume, or with no text of its volume, is not located; repeated names are rows
    each; columns of ``names`` called window, colour or status are replaced.
    """
    names = names.drop("window", "colour", "status")
    asked = names.select(F.col(volume).cast("string").alias("volume"), F.col(genus).cast("string").alias("genus"), F.col(epithet).cast("string").alias("epithet")).dropna().distinct()
    texts = volumes.select(F.col(volume).cast("string").alias("volume"), (F.col(part).cast("string") if part else F.hex(F.xxhash64(text))).alias("part"), F.col(text).cast("string").alias("text")).where(F.col("volume").isNotNull() & (F.length("text") > 0))
    longest = asked.agg(F.max(F.length("genus") + F.length("epithet"))).first()[0] or 0
    lead = longest + WIDEST_GAP + 3
    # Sizes decide how many cells a volume has.
    chars = texts.groupBy("volume").agg(F.ceil(F.sum(F.length("text")) / CELL_CHARS).cast("int").alias("groups"))
    many = asked.groupBy("volume").agg(F.ceil(F.count("*") / CELL_NAMES).cast("int").alias("blocks"))
    sizes = chars.join(many, "volume")
    sizes = F.broadcast(sizes) if many.count() <= FEW_VOLUMES else sizes
    named = asked.join(sizes, "volume").select("volume", F.pmod(F.xxhash64("genus", "epithet"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "genus", "epithet")
    cut = texts.join(sizes, "volume").select("volume", "part", "text", "groups", "blocks", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(CHUNK))).alias("start"))
    begin = F.greatest(F.col("start") - lead, F.lit(0))
    chunk = F.substring("text", begin + 1, F.col("start") - begin + CHUNK + LOCATE_WINDOW + 64)
    chunks = cut.select("volume", F.pmod(F.xxhash64("part", "start"), F.col("groups")).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "start", begin.alias("begin"), chunk.alias("chunk"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {f.split()[0]: [] for f in _FOUND.split(", ")}
        if left.num_rows and right.num_rows:
            own = list(zip(left.column("genus").to_pylist(), left.column("epithet").to_pylist(), strict=True))
            made = Names(own)
            for row in right.to_pylist():
                core = row["start"] - row["begin"]
                for k, (terms, at, end) in best_windows(made, row["chunk"], core or -1, core + CHUNK).items():
                    for name, value in zip(found, (row["volume"], *own[k], terms, row["part"], row["begin"] + at, row["chunk"][at:end]), strict=True):
                        found[name].append(value)
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]]) for f in _FOUND.split(", ")])
        return pa.table(found, schema=schema)

    cell = ["volume", "grp", "block"]
    hits = named.groupBy(*cell).cogroup(chunks.groupBy(*cell)).applyInArrow(run, _FOUND)
    order = F.struct((-F.col("terms")).alias("terms"), "part", "begin")
    best = hits.groupBy("volume", "genus", "epithet").agg(F.min_by("window", order).alias("window"))

    def colours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array([colour_on_organ(w) for w in batch.column("window").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, said], names=[*batch.schema.names, "colour"])

    schema = T.StructType([*best.schema.fields, T.StructField("colour", T.StringType())])
    known = best.mapInArrow(colours, schema).select(*(F.col(c).alias(f"__{c}") for c in ("volume", "genus", "epithet")), "window", "colour")
    same = [F.col(c).cast("string") == F.col(k) for c, k in ((volume, "__volume"), (genus, "__genus"), (epithet, "__epithet"))]
    status = F.when(F.col("window").isNull(), "not_located").when(F.col("colour").isNotNull(), "RECOVERABLE").otherwise("located_no_colour")
    return names.join(known, same, "left").drop("__volume", "__genus", "__epithet").withColumn("status", status)


def recovery_rates(df: DataFrame, group: str, control: str, trusted: float = 0.8) -> DataFrame:
    """Share located, of each group, and whether the control group's share is high enough to trust it."""
    rates = df.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col("status") != "not_located").cast("int")).alias("located"), F.avg((F.col("status") == "RECOVERABLE").cast("int")).alias("recoverable"))
    trust = rates.where(F.col(group) == control).select((F.col("located") >= trusted).alias("trusted"))
    return rates.join(F.broadcast(trust))
