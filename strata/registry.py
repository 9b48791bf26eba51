"""All core queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata import catalog, training

_PARTS = (training, catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in _PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["answers"](spark, sf_dir)
