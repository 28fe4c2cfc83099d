"""Named queries of the library: one Spark callable and, where SQL can say it, one DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries under unique names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, run: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = run
        if oracle is not None:
            self.oracles[name] = oracle

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Decorator form of :meth:`add`."""

        def register(run: Query) -> Query:
            self.add(name, run, oracle)
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
