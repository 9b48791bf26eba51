"""The two budget rules: a prefix that stops at the first line too many, and a greedy fill that skips it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int, spent: Column | None = None) -> DataFrame:
    """Rows whose running cost (on top of ``spent``) stays within ``budget``; groups are ranked lists of bounded length."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = spent if spent is not None else F.lit(0)
    return df.withColumn("used", F.sum(cost).over(w) + start).where(F.col("used") <= budget)


def greedy(costs: Column, budget: int) -> Column:
    """Positions of an ordered array of costs that fit when each that doesn't is skipped."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))
    step = lambda a, c: F.struct(
        F.when(a["used"] + c <= budget, a["used"] + c).otherwise(a["used"]).alias("used"),
        F.when(a["used"] + c <= budget, F.concat(a["kept"], F.array(a["i"]))).otherwise(a["kept"]).alias("kept"),
        (a["i"] + 1).alias("i"),
    )
    return F.aggregate(costs, zero, step, lambda a: a["kept"])
