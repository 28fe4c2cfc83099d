"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import checkpointed

#: Bytes of text that one step of a Python operator holds at once (one row at least).
SLICE_BYTES = 4 << 20


_STATE: dict = {}


def _give_back() -> None:
    """Gives freed memory back to the system, which allocators would keep for a later use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from one task to the next: of one operator at a time.

    Workers are used again by later stages, so memory kept by one operator would add to the next's.
    """
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            _give_back()
        _STATE[key] = make()
    return _STATE[key]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text size."""
    held, start = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            held, start = 0, i
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def set_aside(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of an operator's own names renamed, and what restores the columns of ``docs``."""
    names = {c: f"__aside_{k}" for k, c in enumerate(docs.columns) if c.lower() in own}
    return docs.withColumnsRenamed(names), lambda found: found.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def in_training(doc_id: Column) -> Column:
    """Rows that models may learn from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    """Rows that are tested on; a null id is no such row (nor one to learn from)."""
    return F.coalesce(~in_training(doc_id), F.lit(False))


#: Labels up to which their counts, and keys up to which a sample's choice, are sent to all tasks.
BROADCAST_LABELS, BROADCAST_KEYS = 10_000, 200_000
#: Tasks that a sample is dealt out to.
SAMPLE_PARTS = 32
_HASH_RANGE = float(1 << 62)


def bounded_sample(rows: DataFrame, key: str, text: str, label: str, per_label: int, labels: DataFrame | None = None) -> DataFrame:
    """About ``per_label`` distinct texts of each label, or all if it has no more, as (text, label).

    Labels are a column of ``rows``, or of ``labels`` by the same key.  Copies of a text count once
    (with the lowest label of them), so no group of copies fills the sample.  A text is chosen if its
    hash is below the share that the sample has of its label's texts, so the choice needs no sort and
    no label is one task; the number varies as that of fair draws does (a deviation of the bound's
    square root).  Texts are read again for the chosen keys only.
    """
    texts = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    hashed = texts.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), *([F.col(label).alias("__label")] if labels is None else []))
    if labels is not None:
        hashed = hashed.join(labels.select(F.col(key).alias("__key"), F.col(label).alias("__label")), "__key")
    # Written, as it is read twice and costs a scan of all texts.
    distinct = checkpointed(hashed.where(F.col("__label").isNotNull()).groupBy("__hash").agg(F.min(F.struct("__label", "__key")).alias("__one")).select("__hash", "__one.*"))
    counts = checkpointed(distinct.groupBy("__label").agg(F.count("*").alias("__many")))
    few = counts.count() <= BROADCAST_LABELS
    place = F.pmod(F.xxhash64("__hash"), F.lit(1 << 62)) / F.lit(_HASH_RANGE)
    chosen = distinct.join(F.broadcast(counts) if few else counts, "__label").where((F.col("__many") <= per_label) | (place * F.col("__many") < per_label))
    chosen = checkpointed(chosen.select("__key", "__label", "__hash"))
    sent = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
    found = texts.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(sent, "__key").where(F.xxhash64("text") == F.col("__hash"))
    return found.select("text", F.col("__label").alias("label")).repartition(SAMPLE_PARTS, "text", "label").distinct()
