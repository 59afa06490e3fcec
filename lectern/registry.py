"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries by name; a query may carry the SQL that states the same result for DuckDB."""

    fns: dict[str, QueryFn] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def add(fn: QueryFn) -> QueryFn:
            if name in self.fns:
                raise ValueError(f"query {name!r} is registered twice")
            self.fns[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
