"""Registered queries, each with the table it scans and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = Query(name, fn, sql, covers)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ints(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as the SQL twins return them."""
    return df.select(*[df[c].cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else df[c]
                       for c, t in df.dtypes])
