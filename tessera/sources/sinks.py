"""Writers: overwriting, appending what is new, JSON summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import resume
from tessera.sources.readers import exists


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The chosen columns, with a header, replacing what was there; an empty table has its header."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the Parquet table at ``path`` has not; returns that table.

    Running it again adds nothing, and a run that stopped goes on where it was.
    """
    spark = df.sparkSession
    todo = resume(df, spark.read.parquet(path), key) if exists(spark, path) else df
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_json(one: DataFrame, path: str) -> dict:
    """A one-row table as an indented JSON file of the driver; returns it."""
    row = one.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a summary is one row")
    value = row[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, default=str)
    return value


def append_notes(df: DataFrame, notes: str, added: str) -> DataFrame:
    """Notes with more notes after a bar; blanks add nothing.  Write it to a new path."""
    part = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return df.withColumn(notes, F.concat_ws(" | ", part(notes), part(added))).drop(added)
