"""Registers a query under its function's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registrar() -> tuple[dict[str, tuple[Query, str | None]], Callable[[str | None], Callable[[Query], Query]]]:
    held: dict[str, tuple[Query, str | None]] = {}

    def query(sql: str | None = None):
        def add(f: Query) -> Query:
            held[f.__name__] = (f, sql)
            return f

        return add

    return held, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
