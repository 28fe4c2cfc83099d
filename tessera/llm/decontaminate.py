"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are the runs of digits, ASCII letters (lower-cased) and non-ASCII characters.  A window is
``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Each document's windows are hashed by doubling (no per-window Python), looked up in a bitmap and then
in the hash set, and every find is verified word by word, so no hash collision can count.

The benchmark is broadcast in blocks of bounded size (``block_bytes``).  A worker holds the windows of
one block, and keeps them between tasks if there is but one.  With several, it scans a buffer of
documents with one block after the other; up to ``PASS_BLOCKS`` blocks take one pass over the documents.
A larger benchmark takes more passes, each from a checkpoint of the one before.

Defined cases: null texts have no words and no hits; null or wordless items have no windows; repeated
items count once by ``item_id``; repeated document rows are scanned each; texts are scanned whole, of
any length; empty tables give empty results or no hits; the operator's own columns start with
``hit_`` and replace columns of that name, other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import set_aside, slices, worker_state
from tessera.llm.graph import checkpointed

WINDOW = 10
#: Bytes of benchmark text that one broadcast may hold; blocks of one pass; bytes of documents that are
#: scanned block by block, if there are several; bytes of benchmark that are split into words at once.
BLOCK_BYTES, PASS_BLOCKS, BUFFER_BYTES, BUILD_BYTES = 16 << 20, 16, 64 << 20, 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = 0x9E3779B97F4A7C15
_TYPES = (T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), T.ArrayType(T.StringType()))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` ids, built from runs of powers of two."""
    runs, have, span = ids, None, 0
    size = 1
    while True:
        if width & size:
            if have is None:
                have, span = runs, size
            else:
                n = len(ids) - span - size + 1
                if n <= 0:
                    return ids[:0]
                have = have[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + runs[span : span + n]
                span += size
        size *= 2
        if size > width:
            return have
        half = size // 2
        n = len(ids) - size + 1
        if n <= 0:
            return ids[:0]
        runs = runs[:n] * np.uint64(pow(_BASE, half, 1 << 64)) + runs[half : half + n]


def _word_ids(words: list[bytes]) -> np.ndarray:
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    ids = (ids ^ (ids >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ids ^ (ids >> np.uint64(29))


class _Windows:
    """The hash set of one block's windows, built in each worker (word hashes hold within a process).

    For each window size: sorted window hashes, the place of each window's words in one blob of words, and
    the items that have it.  About 10 bytes a byte of benchmark, 64 MB of bitmap at most.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        self.items: list[str | None] = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        number = {i: k for k, i in enumerate(self.items)}
        blobs: list[bytes] = []
        begins, size_of_blob, words_before = [], 0, 0
        made: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for chunk in _chunks(items, BUILD_BYTES):
            each = [words_of(t) for _, t in chunk]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            flat = [w for x in each for w in x]
            if not flat:
                continue
            ends, ids = np.cumsum(counts), _word_ids(flat)
            owner = np.repeat(np.fromiter((number[i] for i, _ in chunk), np.int32, len(chunk)), counts)
            sizes = np.minimum(counts, width)
            for size in np.unique(sizes[sizes > 0]).tolist():
                hashes = _rolled(ids, size)
                if size == width:
                    at = np.arange(len(hashes))
                    at = at[at + size <= ends[np.searchsorted(ends, at, side="right")]]
                else:
                    at = (ends - counts)[counts == size]
                made.setdefault(size, []).append((hashes[at], at + words_before, owner[at]))
            lengths = np.fromiter(map(len, flat), np.int64, len(flat))
            begins.append(size_of_blob + np.cumsum(lengths + 1) - lengths - 1)
            blobs.append(b" ".join(flat) + b" ")
            size_of_blob, words_before = size_of_blob + len(blobs[-1]), words_before + len(flat)
        self.blob = b"".join(blobs)
        self.begins = np.concatenate([*begins, [size_of_blob]]).astype(np.int64)
        self.tables = {size: self._table(size, *map(np.concatenate, zip(*parts, strict=True))) for size, parts in made.items()}

    def _words(self, at: int, size: int) -> bytes:
        return self.blob[self.begins[at] : self.begins[at + size] - 1]

    def _table(self, size: int, hashes: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple:
        order = np.lexsort((owner, hashes))
        hashes, at, owner = hashes[order], at[order].astype(np.int64), owner[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(hashes)), 0))
        others: dict[int, list[tuple[bytes, int]]] = {}  # windows whose hash another window has
        kept = np.ones(len(hashes), bool)
        for k in np.nonzero(~fresh)[0].tolist():
            if self._words(at[k], size) != self._words(at[first[k]], size):
                others.setdefault(int(hashes[k]), []).append((self._words(at[k], size), int(owner[k])))
                kept[k] = False
            elif owner[k] == owner[k - 1]:
                kept[k] = False
        keys = hashes[fresh]
        owners, group = owner[kept], (np.cumsum(fresh) - 1)[kept]
        starts = np.searchsorted(group, np.arange(len(keys) + 1))
        bits = max(20, min(26, len(keys).bit_length() + 4))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[keys >> np.uint64(64 - bits)] = True
        return keys, at[fresh], starts, owners, others, bitmap, np.uint64(64 - bits)

    def scan(self, words: list[bytes], ends: np.ndarray) -> Iterator[tuple[int, int, object, np.ndarray]]:
        """Occurrences (first word, past the last, the window, its items) over documents laid end to end."""
        if not words:
            return
        ids = _word_ids(words)
        for size, (keys, at, starts, owners, others, bitmap, shift) in self.tables.items():
            hashes = _rolled(ids, size)
            found = np.nonzero(bitmap[hashes >> shift])[0]
            found = found[found + size <= ends[np.searchsorted(ends, found, side="right")]]
            slot = np.minimum(np.searchsorted(keys, hashes[found]), len(keys) - 1)
            same = keys[slot] == hashes[found]
            for place, k in zip(found[same].tolist(), slot[same].tolist(), strict=True):
                said = b" ".join(words[place : place + size])
                if said == self._words(at[k], size):
                    yield place, place + size, (size, k), owners[starts[k] : starts[k + 1]]
                for text, owner in others.get(int(keys[k]), ()):
                    if said == text:
                        yield place, place + size, (size, text, owner), np.array([owner], np.int32)


def _chunks(items: list[tuple[str | None, str | None]], limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    held, out = 0, []
    for item in items:
        out.append(item)
        held += len(item[1] or "")
        if held >= limit:
            yield out
            held, out = 0, []
    if out:
        yield out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[str, list]]:
    """(digest, items) of blocks of about ``block_bytes`` of text; one at a time is on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(-(-total // block_bytes)) or 1
    for k in range(n):  # whole items: a hash of the text deals them out
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        pairs = sorted({(r.item, r.text) for r in block.toLocalIterator()}, key=lambda x: (x[0] is None, x[0] or "", x[1] is None, x[1] or ""))
        yield blake2b(repr(pairs).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), pairs


def _held(batches: Iterator[pa.RecordBatch], column: int, together: bool) -> Iterator[list[pa.RecordBatch]]:
    """The slices to scan with one block before the next: one, or, for several blocks, a buffer of them."""
    held, out = 0, []
    for whole in batches:
        for batch in slices(whole, column):
            out.append(batch)
            held += batch.nbytes
            if not together or held >= BUFFER_BYTES:
                yield out
                held, out = 0, []
    if out:
        yield out


class _Found:
    """Counts, spans and items of a slice's rows, gathered over blocks."""

    def __init__(self, texts: list[str | None], spans: list[list], items: list[set]) -> None:
        self.texts, self.spans, self.items = texts, spans, items
        self.counts = np.zeros(len(texts), np.int64)

    def add(self, windows: _Windows) -> None:
        each = [words_of(t) for t in self.texts]
        self.counts = np.fromiter(map(len, each), np.int64, len(each))
        ends = np.append(np.cumsum(self.counts), np.iinfo(np.int64).max)
        seen: dict[int, set] = {}
        for a, b, window, owners in windows.scan([w for x in each for w in x], ends):
            d = int(np.searchsorted(ends, a, side="right"))
            begin = int(ends[d] - self.counts[d])
            self.spans[d].append((a - begin, b - begin))
            if window not in seen.setdefault(d, set()):
                seen[d].add(window)
                self.items[d].update(map(windows.items.__getitem__, owners.tolist()))
        for d in seen:
            self.spans[d] = _merge(self.spans[d])

    def columns(self) -> list[pa.Array]:
        spans = [[{"start": a, "end": b} for a, b in x] for x in self.spans]
        items = [sorted(x, key=lambda i: (i is None, i or "")) for x in self.items]
        return [pa.array(self.counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds hit_words (words of the text), hit_spans (word ranges hit) and hit_items (ids as strings)."""
    spark = docs.sparkSession
    own = ["hit_words", "hit_spans", "hit_items"]
    out = docs.drop(*own)
    kept, at = out.columns, out.columns.index(text_col)
    schema = T.StructType([*out.schema.fields, *(T.StructField(c, t) for c, t in zip(own, _TYPES, strict=True))])
    blocks, first = _blocks(benchmark, item_id, item_text, block_bytes), True
    while sent := [(key, spark.sparkContext.broadcast(block)) for key, block in islice(blocks, PASS_BLOCKS)]:
        if not first:
            out = checkpointed(out)  # so that the blocks of one pass only are in use

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            for held in _held(batches, at, len(sent) > 1):
                found = []
                for batch in held:
                    spans, items = ([[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)])
                    if not first:
                        spans = [[(s["start"], s["end"]) for s in x] for x in batch.column(len(kept) + 1).to_pylist()]
                        items = [set(x) for x in batch.column(len(kept) + 2).to_pylist()]
                    found.append(_Found(batch.column(at).to_pylist(), spans, items))
                for key, block in sent:
                    windows = worker_state(("windows", key, width), lambda block=block: _Windows(block.value, width))
                    for rows in found:
                        rows.add(windows)
                for batch, rows in zip(held, found, strict=True):
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *rows.columns()], names=[*kept, *own])

        out, first = out.mapInArrow(run, schema), False
    return out


def hit_count() -> Column:
    """Words inside any hit."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents without any hit, with their own columns."""
    fed, restore = set_aside(docs, ("hit_words", "hit_spans", "hit_items"))
    return restore(find_windows(fed, benchmark, text_col, **how).where(F.size("hit_spans") == 0))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents with the words of every hit cut out, from a span's first to its last character."""
    fed, restore = set_aside(docs, ("hit_words", "hit_spans", "hit_items"))
    found = find_windows(fed, benchmark, text_col, **how)
    cols = found.columns
    at, spans_at = cols.index(text_col), cols.index("hit_spans")

    def cut(text: str | None, spans: list) -> str | None:
        if not text or not spans:
            return text
        raw = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in _WORD.finditer(raw)]
        kept, last = [], 0
        for s in spans:
            kept.append(raw[last : places[s["start"]][0]])
            last = places[s["end"] - 1][1]
        return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, at)):
            texts = [cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=cols)

    return restore(found.mapInArrow(run, found.schema))


#: DuckDB SQL of the report, by joining window strings.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT row, i, k, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT row, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bw))),
hits AS (SELECT row, i, dw.k, item_id FROM dw JOIN bw USING (k, win)),
pos AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM hits) GROUP BY row),
its AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (row) LEFT JOIN its USING (row)"""
