"""Audit: recomputed figures against expected ones, and invariants as counts of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schemas import CHECKS, KNOWN


class Audit:
    """Collects checks; each is a one-row table, so nothing is computed before ``table``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows = spark, []

    def _add(self, one: DataFrame, section: str, name: str, got: Column, want, detail: Column, passed: Column) -> None:
        status = F.when(got.isNull(), "PEND").when(passed, "PASS").otherwise("FAIL")
        self.rows.append(one.select(F.lit(section).alias("section"), F.lit(name).alias("name"), got.cast("string").alias("got"), F.lit(str(want)).alias("want"), detail.alias("detail"), status.alias("status")))

    def equal(self, section: str, name: str, one: DataFrame, column: str, want: float, tolerance: float = 5e-4) -> None:
        """A number within a tolerance; a null one is pending."""
        gap = F.abs(F.col(column).cast("double") - want)
        self._add(one, section, name, F.col(column), want, F.lit(f"tolerance {tolerance}"), gap <= tolerance)

    def same(self, section: str, name: str, one: DataFrame, column: str, want: str) -> None:
        self._add(one, section, name, F.col(column), want, F.lit("equal"), F.col(column) == want)

    def none(self, section: str, name: str, violations: DataFrame) -> None:
        """No rows: ``violations`` selects what must not be."""
        counted = violations.agg(F.count("*").alias("n"))
        self._add(counted, section, name, F.col("n"), 0, F.lit("violations"), F.col("n") == 0)

    def pending(self, section: str, name: str) -> None:
        """A check whose input is absent."""
        absent = self.spark.range(1).select(F.lit(None).cast("string").alias("x"))
        self._add(absent, section, name, F.col("x"), "", F.lit("input is absent"), F.lit(False))

    def table(self) -> DataFrame:
        if not self.rows:
            return self.spark.createDataFrame([], CHECKS)
        return reduce(DataFrame.unionByName, self.rows)


def summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def exit_code(checks: DataFrame) -> int:
    """1 if a check failed; pending ones do not fail."""
    return int(not checks.where("status = 'FAIL'").isEmpty())


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def not_falling(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns do not fall from left to right, as a funnel must."""
    rises = reduce(lambda a, b: a | b, (F.col(x) < F.col(y) for x, y in zip(columns, columns[1:], strict=False)))
    return df.where(rises)


def leaked(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is no known colour."""
    return df.where(~F.coalesce(F.col(label).isin(*KNOWN), F.lit(False)))


def disordered(df: DataFrame, lower: str, middle: str, upper: str) -> DataFrame:
    return df.where((F.col(lower) > F.col(middle)) | (F.col(middle) > F.col(upper)))


def overwritten(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text was not empty before and is another after."""
    old = before.select(key, F.col(text).alias("__old")).where("__old is not null and __old <> ''")
    return old.join(after, key).where(~F.col(text).eqNullSafe(F.col("__old")))


def stop_on_null(df: DataFrame, column: str) -> DataFrame:
    """``df``, stopping the job at a null target."""
    kind = df.schema[column].dataType
    stop = F.raise_error(F.lit(f"{column} is null")).cast(kind if not isinstance(kind, T.NullType) else "string")
    return df.withColumn(column, F.when(F.col(column).isNull(), stop).otherwise(F.col(column)))
