"""Readers: tolerant CSV, whole texts, manifests, task lists, fetched and extracted records.

Schemas are always given, so no pass over the data infers one, and blank text stays blank (it is a
value, and a key, of its own).  Paths may be anything that Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import volume_of
from tessera.operators.joins import resume

#: A text that no file holds: with it as the null mark, blanks are read as blanks.
NO_NULL = "\u0001null\u0001"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """CSV with a header, quoted newlines, fields of any length and, perhaps, a byte-order mark."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", "-1").option("nullValue", NO_NULL).option("emptyValue", "").option("enforceSchema", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    rows = reader.options(**options).csv(path)
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return rows.fillna("", texts)  # a CSV file has no nulls: what is not there is blank


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file without a byte-order mark."""
    line = spark.read.text(path).first()
    return [c.strip().strip('"') for c in (line[0] if line else "").lstrip("﻿").split(",")]


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV; lines that start with # and rows of fewer fields are left out."""
    rows = spark.read.schema(schema).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    return rows.where(F.col(schema.names[-1]).isNotNull())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any file system that Spark reads, is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table, or None where the file is not there yet."""
    return read_csv(spark, path, schema) if exists(spark, path) else None


def read_volumes(spark: SparkSession, glob: str) -> DataFrame:
    """(volume, text) of whole files, the volume from the file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(glob, wholetext=True).select(volume_of(F.url_decode(name)).alias("volume"), F.col("value").alias("text"))


def read_binary_text(spark: SparkSession, glob: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary documents by a converter that the caller brings."""
    files = spark.read.format("binaryFile").load(glob)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [to_text(b) for b in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


@dataclass(frozen=True)
class Task:
    """What to extract: input, its text and id columns, output."""

    source: str
    text: str
    key: str
    output: str


def parse_tasks(specs: list[str]) -> list[Task]:
    """``input::text column::id column::output``, one each."""
    out = []
    for spec in specs:
        parts = spec.split("::")
        if len(parts) != 4:
            raise ValueError(f"a task has four parts: {spec}")
        out.append(Task(*parts))
    return out


def fetch_records(keys: DataFrame, key: str, cache: DataFrame | None, client: Callable[[str], tuple[str, list[dict]]], schema: str) -> DataFrame:
    """Records of keys that the cache does not hold: (key, status, message, fields of ``schema``).

    ``client`` answers (status, records); an exception is status ``error``, with its text as message; a key without records has
    one row of nulls, so it is not asked for again.  One client call a key, spread over the tasks.
    """
    todo = keys.select(key).distinct() if cache is None else resume(keys.select(key).distinct(), cache, key)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf[key]:
                message = None
                try:
                    status, records = client(k)
                except Exception as e:  # noqa: BLE001  the status says so
                    status, records, message = "error", [], str(e)
                rows += [{key: k, "status": status, "message": message, **r} for r in records] or [{key: k, "status": status, "message": message}]
            yield pd.DataFrame(rows, columns=[key, "status", "message", *names])

    return todo.mapInPandas(run, f"{key} string, status string, message string, {schema}")


def extract(df: DataFrame, key: str, text: str, extractor: Callable[[str], str], out: str = "flower_color_free_text") -> DataFrame:
    """(key, phrase) by an extractor that the caller brings; an exception gives ``ERROR: ...``.

    A missing column is an error before any work.
    """
    if missing := [c for c in (key, text) if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")

    def one(t: str | None) -> str:
        try:
            return extractor(t or "")
        except Exception as e:  # noqa: BLE001  the answer says so
            return f"ERROR: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], out: [one(t) for t in pdf[text]]})

    return df.select(F.col(key).cast("string").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, f"{key} string, {out} string")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
