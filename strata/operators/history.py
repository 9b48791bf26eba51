"""Validity intervals of changing attributes, and their affected-chain rebuild.

A *chain* is all versions of one key (for example subject and predicate). The
interval of a version follows from the raw changes alone, so a late or corrected
change is applied by rebuilding only the chains it touches and putting the new
chains in the place of the old ones.

Hot chains: a key may hold a third of all rows, all of one month perhaps. So rows
are range-partitioned by key and time, and a *block* is what one range partition
holds of a key: bounded by rows, however they lie in time. Every window below is
partitioned by the key **and** the block, and the state that crosses a block
border travels through per-block summaries, of which a key has only as many as
it has blocks. No task ever holds a whole chain.

Defined cases: rows with a null key part, time or value change nothing; repeated
rows count once; of rows of a key with the same time the latest ``recorded``
wins, then the largest value (positive before negative); an empty table gives an
empty history; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import squeeze
from strata.session import cut, shared_dir

RAW = ("subject", "predicate", "value", "positive", "at", "recorded")


def raw_changes(df: DataFrame, predicates: Sequence[str] | None = None) -> DataFrame:
    """Raw changes from fact rows: value is the object in lower case, single spaced."""
    if predicates is not None:
        df = df.where(F.col("predicate").isin(list(predicates)))
    return df.select(
        "subject",
        "predicate",
        F.lower(squeeze(F.col("object"))).alias("value"),
        F.coalesce(F.lower(F.trim("polarity")) != "negative", F.lit(True)).alias("positive"),
        F.col("valid_from").alias("at"),
        F.col("recorded_at").alias("recorded"),
    )


def build_chains(raw: DataFrame, blocks: int | None = None) -> DataFrame:
    """(subject, predicate, value, valid_from, valid_until) of every version; an open end is null.

    A positive row starts a version unless its value already holds; the version
    ends when another starts or at a negative row of the same value; a negative
    row of another value changes nothing. ``blocks``: range partitions, by default
    as many as a shuffle has; they are stored once, so that they stay what they are.
    """
    key = ["subject", "predicate"]
    n = blocks or int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    known = raw.where("subject is not null and predicate is not null and value is not null and at is not null")
    # rows of one key and time lie in one range, so they are merged there without another shuffle
    rows = known.repartitionByRange(n, *key, "at").groupBy(*key, "at").agg(F.max(F.struct("recorded", "positive", "value")).alias("w"))
    rows = cut(rows.select(*key, "at", F.col("w.value").alias("value"), F.col("w.positive").alias("positive"), F.spark_partition_id().alias("block")), "changes")
    # 1. the last positive row before each row, and the last negative row of the same value
    inside = Window.partitionBy(*key, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside_v = Window.partitionBy(*key, "block", "value").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside_v_next = Window.partitionBy(*key, "block", "value").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    pos = F.when(F.col("positive"), F.struct("at", "value"))
    neg = F.when(~F.col("positive"), F.col("at"))
    marked = rows.select(
        "*",
        F.last(pos, ignorenulls=True).over(inside).alias("pos_in"),
        F.last(neg, ignorenulls=True).over(inside_v).alias("neg_in"),
        F.first(neg, ignorenulls=True).over(inside_v_next).alias("next_neg_in"),
    )
    # 2. what earlier and later blocks hand over, from one summary row per key (and value) and block
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    before_v = Window.partitionBy(*key, "value").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after_v = Window.partitionBy(*key, "value").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    carry_pos = rows.groupBy(*key, "block").agg(F.max(pos).alias("p")).select(*key, "block", F.last("p", ignorenulls=True).over(before).alias("pos_carry"))
    carry_neg = (
        rows.groupBy(*key, "value", "block")
        .agg(F.max(neg).alias("n1"), F.min(neg).alias("n0"))
        .select(*key, "value", "block", F.last("n1", ignorenulls=True).over(before_v).alias("neg_carry"), F.first("n0", ignorenulls=True).over(after_v).alias("next_neg_carry"))
    )
    known = marked.where("positive").join(carry_pos, [*key, "block"], "left").join(carry_neg, [*key, "block", "value"], "left")
    prev = F.coalesce("pos_in", "pos_carry")
    starts = (
        known.select(*key, "block", "value", "at", prev.alias("prev"), F.coalesce("neg_in", "neg_carry").alias("neg_before"), F.coalesce("next_neg_in", "next_neg_carry").alias("neg_after"))
        .where("prev is null or prev.value <> value or coalesce(neg_before > prev.at, false)")
        .select(*key, "block", "value", "at", "neg_after")
    )
    # 3. the next start of any value ends the version, unless its own negative row comes first
    within = Window.partitionBy(*key, "block").orderBy("at")
    carry_next = starts.groupBy(*key, "block").agg(F.min("at").alias("f")).select(*key, "block", F.first("f").over(after).alias("next_carry"))
    return (
        starts.withColumn("next_in", F.lead("at").over(within))
        .join(carry_next, [*key, "block"], "left")
        .select(*key, "value", F.col("at").alias("valid_from"), F.least(F.coalesce("next_in", "next_carry"), "neg_after").alias("valid_until"))
    )


def affected(raw: DataFrame, batch: DataFrame) -> DataFrame:
    """The raw changes of every chain that ``batch`` touches, with the batch itself."""
    key = ["subject", "predicate"]
    touched = batch.select(*key).distinct()
    return raw.select(*RAW).unionByName(batch.select(*RAW)).join(touched, key, "left_semi")


def rebuild_affected(history: DataFrame, raw: DataFrame, batch: DataFrame, blocks: int | None = None) -> DataFrame:
    """History after ``batch``: touched chains rebuilt from their raw changes, all others as they are.

    ``history`` must be the chains of ``raw``. A chain never mixes old and new
    versions, since it is removed and added as a whole.
    """
    touched = batch.select("subject", "predicate").distinct()
    kept = history.join(touched, ["subject", "predicate"], "left_anti")
    return kept.unionByName(build_chains(affected(raw, batch), blocks))


class HistoryTable:
    """A stored history whose chains are replaced atomically.

    Chains and raw changes lie in buckets of the key's hash. A batch reads and
    rewrites the chains of the buckets it touches, appends its own rows to their raw
    changes and names all else in the next manifest as it is; then one small pointer
    flips. Readers see the old or the new version, never a mixture, and a job that
    dies leaves the pointer as it was. ``buckets`` should grow with the table (a
    bucket of some GB); a hot key's bucket is still many files.
    """

    MANIFEST = "what string, bucket int, path string"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        from strata.sources.store import Versions

        self.spark, self.buckets = spark, buckets
        self.versions = Versions(spark, path or shared_dir(spark, "history"))

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("subject", "predicate"), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, folder: str, what: str, spread: Column) -> list[tuple[str, int, str]]:
        """Writes rows by bucket, a bucket over several files; returns their manifest rows."""
        salted = self._bucketed(df).withColumn("salt_", F.pmod(spread, F.lit(4)))
        salted.repartition("bucket", "salt_").drop("salt_").write.partitionBy("bucket").parquet(f"{folder}/{what}")
        return [(what, b, f"{folder}/{what}/bucket={b}") for b in self.versions.subfolders(f"{folder}/{what}", "bucket=")]

    def manifest(self) -> list[tuple[str, int, str]]:
        """(what, bucket, path) of all parts: as many rows as buckets and appended batches."""
        return [tuple(r) for r in self.spark.read.schema(self.MANIFEST).parquet(self.versions.current() + "/manifest").collect()]

    def _read(self, parts: list[tuple[str, int, str]], what: str, schema: str) -> DataFrame:
        paths = [p for w, _, p in parts if w == what]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, what: str = "chains") -> DataFrame:
        return self._read(self.manifest(), what, _SCHEMAS[what])

    def load(self, raw: DataFrame) -> None:
        with self.versions.next() as folder:
            parts = self._write(raw.select(*RAW), folder, "raw", F.unix_micros("at"))
            parts += self._write(build_chains(self._read(parts, "raw", _SCHEMAS["raw"])), folder, "chains", F.unix_micros("valid_from"))
            self._commit(folder, parts)

    def apply(self, batch: DataFrame) -> None:
        """The affected chains rebuilt from all their raw changes, in the place of the old ones."""
        with self.versions.next() as folder:
            old = self.manifest()
            new = self._write(batch.select(*RAW), folder, "raw", F.unix_micros("at"))
            hit = {b for _, b, _ in new}
            within = [p for p in old if p[1] in hit]
            late = self._read(new, "raw", _SCHEMAS["raw"])
            chains = rebuild_affected(self._read(within, "chains", _SCHEMAS["chains"]), self._read(within, "raw", _SCHEMAS["raw"]), late)
            new += self._write(chains, folder, "chains", F.unix_micros("valid_from"))
            self._commit(folder, [p for p in old if p[0] == "raw" or p[1] not in hit] + new)

    def _commit(self, folder: str, parts: list[tuple[str, int, str]]) -> None:
        self.spark.createDataFrame(parts, self.MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")


_SCHEMAS = {
    "raw": "subject string, predicate string, value string, positive boolean, at timestamp, recorded timestamp",
    "chains": "subject string, predicate string, value string, valid_from timestamp, valid_until timestamp",
}


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The versions that held at an instant (start included, end excluded)."""
    return history.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
