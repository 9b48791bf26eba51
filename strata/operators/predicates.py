"""Predicates of the graph contract as column expressions, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def eq(value: Any) -> Test:
    """Equality; None asks for null."""
    return (lambda c: c.isNull()) if value is None else (lambda c: c == F.lit(value))


def ne(value: Any) -> Test:
    """Inequality; null rows don't pass, None asks for any value."""
    return (lambda c: c.isNotNull()) if value is None else (lambda c: c != F.lit(value))


def in_(values: Sequence[Any]) -> Test:
    """Membership; an empty list passes nothing."""
    vs = list(values)
    return (lambda c: c.isin(vs)) if vs else (lambda c: F.lit(False))


def gt(value: Any) -> Test:
    return lambda c: c > F.lit(value)


def gte(value: Any) -> Test:
    return lambda c: c >= F.lit(value)


def lt(value: Any) -> Test:
    return lambda c: c < F.lit(value)


def lte(value: Any) -> Test:
    return lambda c: c <= F.lit(value)


def is_null() -> Test:
    return lambda c: c.isNull()


def not_null() -> Test:
    return lambda c: c.isNotNull()


def contains(part: str) -> Test:
    """Substring in any case; no character is a wildcard."""
    return lambda c: F.contains(F.lower(c), F.lit(part.lower()))


def where(df: DataFrame, tests: Mapping[str, Any] | None) -> DataFrame:
    """Rows that pass all tests; a plain value means equality. Unknown columns are an error."""
    if not tests:
        return df
    unknown = [k for k in tests if k not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    conditions = [(t if callable(t) else eq(t))(F.col(f"`{k}`")) for k, t in tests.items()]
    return df.where(reduce(lambda a, b: a & b, conditions))


def match(df: DataFrame, tests: Mapping[str, Any] | None = None, order_by: Sequence[tuple[str, str]] = (), limit: int | None = None, skip: int = 0) -> DataFrame:
    """Filter, order (a direction that begins with d is descending; nulls first when ascending), skip and limit."""
    out = where(df, tests)
    if order_by:
        out = out.orderBy(*[F.col(c).desc() if d.lower().startswith("d") else F.col(c).asc() for c, d in order_by])
    if skip:
        out = out.offset(skip)
    return out.limit(limit) if limit is not None else out
