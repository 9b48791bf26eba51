"""Learned routing: outcome rates per (query type, path), the routing table and the choice of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.lexical import QUERY_CUES

# fixed values: retrieval paths and the default path of each query type
PATHS = [("semantic-only", ["semantic"], 1, False), ("episodic-depth-3", ["episodic"], 3, False), ("hybrid-conflict", ["semantic", "episodic"], 2, True), ("episodic-depth-2", ["episodic"], 2, False)]
DEFAULT_PATH = {"temporal": "episodic-depth-3", "preference": "hybrid-conflict", "factual": "semantic-only", "procedural": "episodic-depth-2"}
EPSILON, TRUSTED = 0.15, 3


def seeds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(query types, paths) as tables; equal on every call."""
    types = spark.createDataFrame([(k, QUERY_CUES[k], DEFAULT_PATH[k]) for k in QUERY_CUES], "name string, keywords array<string>, default_path string")
    return types, spark.createDataFrame(PATHS, "name string, layers array<string>, max_depth int, use_conflict_resolution boolean")


def rates(outcomes: DataFrame) -> DataFrame:
    """(query_type, path, attempts, successes, success_rate, avg_latency_ms, avg_tokens): rate is Laplace
    smoothed. Rebuilt from the outcomes, so feedback only ever appends."""
    g = outcomes.groupBy("query_type", "path").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.avg("latency_ms").alias("l"), F.avg("tokens_used").alias("t"))
    rate = F.bround((F.col("successes") + 1) / (F.col("attempts") + 2), 4)
    return g.select("query_type", "path", "attempts", "successes", rate.alias("success_rate"), F.bround("l", 2).alias("avg_latency_ms"), F.bround("t", 2).alias("avg_tokens"))


def routing_table(rated: DataFrame) -> DataFrame:
    """(query_type, entries): paths of each type, the best rate first, then the name."""
    entry = F.struct((-F.col("success_rate")).alias("k"), F.col("path").alias("path"), F.col("attempts").alias("attempts"))
    return rated.groupBy("query_type").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("query_type", F.transform("e", lambda x: F.struct(x["path"].alias("path"), (-x["k"]).alias("success_rate"), x["attempts"].alias("attempts"))).alias("entries"))


def best_path(questions: DataFrame, rated: DataFrame, explore: bool = False, draw: Column | None = None) -> DataFrame:
    """``questions`` (query_id, query_type) with ``path`` and ``reason``.

    Paths tried at least TRUSTED times compete by (rate, attempts), then name; with
    none trusted the type's default holds. With ``explore`` a share EPSILON of the
    questions takes a random path, drawn from the query id so that reruns agree.
    """
    trusted = rated.where(F.col("attempts") >= TRUSTED)
    best = trusted.groupBy("query_type").agg(F.min(F.struct((-F.col("success_rate")).alias("r"), (-F.col("attempts")).alias("n"), "path"))["path"].alias("learned"))
    j = questions.join(F.broadcast(best), "query_type", "left")
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_PATH.items() for x in kv])
    usual = F.coalesce("learned", F.try_element_at(default, F.col("query_type")), F.lit("semantic-only"))
    u = draw if draw is not None else F.pmod(F.xxhash64("query_id"), F.lit(10_000)) / 10_000
    names = F.array(*[F.lit(p[0]) for p in PATHS])
    tried = (u < EPSILON) & F.col("learned").isNotNull() if explore else F.lit(False)
    random = F.get(names, F.pmod(F.xxhash64("query_id", F.lit("path")), F.lit(len(PATHS))).cast("int"))
    return j.select(*questions.columns, F.when(tried, random).otherwise(usual).alias("path"), F.when(tried, "explore").when(F.col("learned").isNotNull(), "learned").otherwise("default").alias("reason"))


def running_rates(outcomes: DataFrame, order: Column) -> DataFrame:
    """The rate before each outcome, for regret reports."""
    w = Window.partitionBy("query_type", "path").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, s = F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)), F.coalesce(F.sum(F.col("success").cast("int")).over(w), F.lit(0))
    return outcomes.withColumn("rate_before", F.bround((s + 1) / (n + 2), 4))
