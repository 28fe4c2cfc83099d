"""Resumable extraction as a stream: new input files are extracted once, each batch appended.

Not part of parity: the batch form is ``sinks.append_new``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.readers import extract
from tessera.sources.sinks import append_new


def extract_stream(spark: SparkSession, source: str, schema: T.StructType, key: str, text: str, extractor: Callable[[str], str], output: str, checkpoint: str) -> StreamingQuery:
    """Extracts rows of Parquet files as they come.

    A batch that runs again after a failure adds nothing twice: its keys are in the output already.
    """

    def each(batch: DataFrame, _: int) -> None:
        append_new(extract(batch.dropDuplicates([key]), key, text, extractor), output, key)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of a kind by window of time; works on streams (with a watermark) and on tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
