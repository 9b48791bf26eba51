"""Small helpers that shape a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, **exprs: Column) -> DataFrame:
    """``df`` with columns that are computed exactly once.

    A filter on a computed column is pushed below the projection that computes
    it, which then runs twice. The columns pass through a generator of one
    element here, which filters are not pushed through.
    """
    held = F.struct(*[e.alias(n) for n, e in exprs.items()])
    keep = [F.col(c) for c in df.columns if c not in exprs]
    return df.select(*keep, F.explode_outer(F.array(held)).alias("held_")).select(*keep, *[F.col(f"held_.{n}").alias(n) for n in exprs])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if its input has fewer.

    For costly expressions over few files; large inputs have more partitions
    than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
