"""Queries of the general training-data problems (the llm ones live in ``strata.llm``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import visible
from strata.operators import history, nested, timestamps
from strata.session import read_table

#: predicates that state one value per subject at a time
SINGLE_VALUED = ("works_at", "favorite_color", "favorite_beverage", "prefers@editor")
#: rows written more than this after they became valid arrive as the late batch
LATE_AFTER = "INTERVAL 1 DAY"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the single-valued predicates.

    Rows written in time make the first history; late ones are then applied by
    rebuilding the chains they touch.
    """
    raw = history.raw_changes(read_table(spark, sf_dir, "facts"), SINGLE_VALUED)
    is_late = F.coalesce(F.expr(f"recorded > at + {LATE_AFTER}"), F.lit(False))
    table = history.HistoryTable(spark)
    table.load(raw.where(~is_late))
    table.apply(raw.where(is_late))
    versions = table.read()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return versions.select("subject", "predicate", "value", us("valid_from").alias("from_us"), F.coalesce(us("valid_until"), F.lit(-1)).cast("bigint").alias("until_us"))


P2_SQL = """
WITH c AS (
  SELECT subject, predicate, lower(trim(regexp_replace(object, '\\s+', ' ', 'g'))) AS value,
         coalesce(lower(trim(polarity)) <> 'negative', true) AS positive, valid_from AS ts, recorded_at AS recorded
  FROM facts
  WHERE predicate IN ('works_at','favorite_color','favorite_beverage','prefers@editor')
    AND subject IS NOT NULL AND object IS NOT NULL AND valid_from IS NOT NULL),
w AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY subject, predicate, ts ORDER BY recorded DESC NULLS LAST, positive DESC, value DESC) = 1),
p AS (
  SELECT *,
    last_value(CASE WHEN positive THEN value END IGNORE NULLS) OVER k AS prev_value,
    last_value(CASE WHEN positive THEN ts END IGNORE NULLS) OVER k AS prev_at,
    last_value(CASE WHEN NOT positive THEN ts END IGNORE NULLS) OVER kv AS neg_before,
    first_value(CASE WHEN NOT positive THEN ts END IGNORE NULLS) OVER kn AS neg_after
  FROM w
  WINDOW k AS (PARTITION BY subject, predicate ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         kv AS (PARTITION BY subject, predicate, value ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         kn AS (PARTITION BY subject, predicate, value ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (
  SELECT *, lead(ts) OVER (PARTITION BY subject, predicate ORDER BY ts) AS next_at
  FROM p WHERE positive AND (prev_value IS NULL OR prev_value <> value OR coalesce(neg_before > prev_at, false)))
SELECT subject, predicate, value, epoch_us(ts) AS from_us, coalesce(epoch_us(least(next_at, neg_after)), -1) AS until_us
FROM s
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns (att_pos -1, label the speaker) and named attachments with the keys of their parents."""
    turns = nested.turn_rows(nested.session_rows(read_table(spark, sf_dir, "demo_user")))
    key = ["record_id", "session_pos", "turn_pos"]
    own = F.array(F.struct(F.lit(-1).alias("att_pos"), F.col("speaker").alias("label")))
    planned = nested.plan_relations(nested.SESSION_GRAPH, "record")["attachment"]
    each = F.transform(nested.children(F.col("item_"), planned, "turn", "att_pos"), lambda a: F.struct(a["att_pos"], F.coalesce(a["name"], a["bare"]).alias("label")))
    names = F.filter(each, lambda a: visible(a["label"]))
    return turns.select(*key, F.explode(F.concat(own, names)).alias("r")).select(*key, "r.att_pos", "r.label").distinct()


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct parents of every planned table."""
    out = None
    for name, rows in nested.tables(read_table(spark, sf_dir, "demo_user").distinct()).items():
        keys = [c for c in rows.columns if c == "record_id" or c.endswith("_pos")]
        one = rows.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(*keys[:-1])).alias("parents"), F.countDistinct(F.struct(*keys)).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that names a real instant, in microseconds since 1970 UTC."""
    req = read_table(spark, sf_dir, "ingest_requests").select("request_id", "timestamp", "client_zone", "turns")
    sessions = nested.session_rows(read_table(spark, sf_dir, "demo_user"))
    rid = F.col("request_id").cast("string")
    own = F.array(F.struct(F.lit("request").alias("src"), rid.alias("rec"), F.col("timestamp").alias("value")))
    turns = F.transform(F.coalesce("turns", F.array()), lambda t, i: F.struct(F.lit("turn").alias("src"), F.concat_ws("/", rid, i.cast("string")).alias("rec"), t["timestamp"].alias("value")))
    rows = req.select(F.col("client_zone").alias("zone"), F.explode(F.concat(own, turns)).alias("r")).select("r.*", "zone")
    demo = sessions.select(F.lit("demo").alias("src"), F.concat_ws("/", F.col("record_id").cast("string"), F.col("session_pos").cast("string")).alias("rec"), F.coalesce("timestamp", "start_time").alias("value"), F.col("tz").alias("zone"))
    found = timestamps.resolve(rows.unionByName(demo).where("value is not null"), "value", "utc_us", "zone")
    return found.where("utc_us is not null").select("src", "rec", "utc_us").distinct()


def queries() -> dict:
    return {"p2_found": p2_found, "p5_found": p5_found, "p5_tables": p5_tables, "p7_found": p7_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
