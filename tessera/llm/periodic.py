"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that can hold a run.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), at least
``least(q)`` long, that no neighbouring word extends.  A stretch of length l and period q is an island of
l - q equal pairs at lag q, so a lag with fewer equal pairs in the whole text than an island needs holds
none.  Pairs are counted by word: for the frequent words by the autocorrelation of their places, exact after
rounding, whose spectra are summed before one inverse transform; for the others by the differences of their
places.  With the bound between the two at sqrt(n log n) places a text of n words costs O(n^1.5 log n).

Lags are taken upwards.  A found run of period q explains the equal pairs that it holds at lags 2q, 3q, ...;
they are taken off the counts, so a text of one repeated word is scanned at one lag only.  A lag that is left
is probed at every half island first, and scanned whole if a probe finds a match.  An island that is a found
run again has a smaller period and is no run of this one.

Defined cases: a null or wordless text has no words and no runs, and collapses to the empty text; whole texts
of any length are read; a row's result depends on its text alone, so ties and repeated rows give equal results,
null ids included; an empty table gives an empty result; no column but the id and the text is read, so extra
columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Words of a text, and the same as Spark's engine writes it.
WORD, GAP = re.compile(r"[^\x20\x09-\x0D]+"), r"[\x20\x09-\x0D]+"
#: A run is at least so many words, and so many periods, long.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of places that are held at once.
PAIRS = 1 << 20


def numbered(words: list[str]) -> np.ndarray:
    """Each word by a number of its own."""
    number: dict[str, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _differences(places: np.ndarray, ends: np.ndarray, lags: int) -> np.ndarray:
    """How often each lag lies between two places of one word; ``ends``: behind the last place of the word."""
    counts = np.zeros(lags + 1, np.int64)
    after = ends - np.arange(len(places)) - 1
    bounds = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + PAIRS, PAIRS), side="right")
    for a, b in zip(bounds, [*bounds[1:], len(places)], strict=True):
        many = after[a:b]
        if not many.sum():
            continue
        left = np.repeat(np.arange(a, b), many)
        step = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + 1
        lag = places[left + step] - places[left]
        counts += np.bincount(lag[lag <= lags], minlength=lags + 1)
    return counts


def equal_pairs(ids: np.ndarray, lags: int, bound: float | None = None) -> np.ndarray:
    """For each lag up to ``lags`` how many words equal the word that many places on.

    ``bound``: places from which a word is a frequent one.
    """
    n = len(ids)
    bound = np.sqrt(n * max(1.0, np.log2(max(n, 2)))) if bound is None else bound
    often = np.bincount(ids)
    order = np.argsort(ids, kind="stable")
    frequency = often[ids[order]]
    light = (frequency <= bound) & (frequency > 1)
    counts = np.zeros(lags + 1, np.int64)
    if light.any():
        places = order[light]
        own = ids[places]
        counts += _differences(places, np.searchsorted(own, own, side="right"), lags)
    heavy = np.nonzero(often > bound)[0]
    if len(heavy):
        size = 1 << int(n + lags).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)
    return counts


def _islands(ids: np.ndarray, q: int, need: int) -> Iterator[tuple[int, int]]:
    """(start, pairs) of each stretch of at least ``need`` equal pairs at lag q."""
    n = len(ids)
    half = max(1, (need + 1) // 2)  # of any island, some half begins at a probe and lies in it
    probes = np.arange(0, n - q, half)
    for k in range(min(half, 3)):
        probes = probes[probes + k < n - q]
        probes = probes[ids[probes + k] == ids[probes + k + q]]
        if not len(probes):
            return
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    for k in np.flatnonzero(lengths >= need):
        yield int(starts[k]), int(lengths[k])


def runs_of(ids: np.ndarray, bound: float | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    lags = n // LEAST_PERIODS
    if n < LEAST_WORDS or not lags:
        return []
    lag = np.arange(lags + 1)
    need = np.maximum(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)
    counts = equal_pairs(ids, lags, bound)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(counts >= need).tolist():
        if q == 0 or counts[q] < need[q]:
            continue
        for start, pairs in _islands(ids, q, int(need[q])):
            if (start, pairs + q) not in found:
                found[start, pairs + q] = q
                more = np.arange(2 * q, min(pairs + q, lags + 1), q)
                counts[more] -= pairs + q - more
    return sorted((start, length, q) for (start, length), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    ``runs`` are all runs by start, then period; ``collapsed`` is the text of the words that stay when each
    run is cut to its first period, joined by one space.  One pass without a shuffle; memory is that of one
    text's words.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sizes, every, collapsed = [], [], []
                for text in batch.column(1).to_pylist():
                    words = WORD.findall(text or "")
                    runs = runs_of(numbered(words))
                    if runs:
                        words_kept = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                    else:
                        words_kept = words
                    sizes.append(len(words))
                    every.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    collapsed.append(" ".join(words_kept))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(every, run_type), pa.array(collapsed, pa.string())], names=["key", "n_words", "runs", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("key", id_col)


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text, with its words from some place on repeated periodically where crc32(id) ends in 0.

    h = crc32(decimal id), g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8); word i >= a becomes
    word a + (i - a) mod p.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, GAP), lambda w: w != "")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.when(n > 0, g % n)
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8))
        again = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(words, (a + (i - a) % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")

    # The words are made once: the inner function takes them as the only element of an array.
    made = F.element_at(F.transform(F.array(words), planted), 1)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), made).otherwise(text)


def longest(runs: Column) -> Column:
    """The longest of an array of runs; of equals the first by start, then period.  Null if there is none."""
    key = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return F.when(key.isNotNull(), F.struct(key["s"].alias("start"), (-key["l"]).alias("length"), key["p"].alias("period")))
