"""Queries of the llm problems and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.plan import spread
from strata.llm import canonical, conversations, encode, packing, pii, quality, survivors
from strata.operators import nested
from strata.session import cut, read_table

#: predicates whose rows state the same thing several times
REPEATED = ("likes", "has", "learning", "allergic_to")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every sound session, from the replayed stream of turns."""
    return conversations.sound_turns(conversations.replay(spark, f"{sf_dir}/turns.parquet"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical entry meant by every typed value, -1 for none."""
    facts = read_table(spark, sf_dir, "facts").where("predicate in ('lives_in', 'role', 'uses_tool')")
    kind = F.expr("CASE predicate WHEN 'lives_in' THEN 'city' WHEN 'role' THEN 'job_title' ELSE 'tool' END")
    typed = F.expr("CASE entity_type WHEN 'place' THEN 'city' WHEN 'occupation' THEN 'job_title' WHEN 'technology' THEN 'tool' WHEN 'organization' THEN 'company' END")
    rows = facts.select(F.lit("facts").alias("src"), F.col("id").alias("rec_id"), F.col("object").alias("value"), kind.alias("category")).unionByName(
        read_table(spark, sf_dir, "entities").select(F.lit("entities").alias("src"), F.col("id").alias("rec_id"), F.col("name").alias("value"), typed.alias("category"))
    )
    return canonical.map_values(rows, read_table(spark, sf_dir, "canon_items")).select("src", "rec_id", F.col("item_id").cast("bigint").alias("item_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivor of every group of repeated facts."""
    return survivors.survivors(read_table(spark, sf_dir, "facts").where(F.col("predicate").isin(*REPEATED)))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records built for the groups, undated qualifiers ordered by learned precedence."""
    return survivors.surviving_records(read_table(spark, sf_dir, "facts").where(F.col("predicate").isin(*REPEATED)))


def p4_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct source_sessions and evidence of every group, one row each."""
    return survivors.gathered(read_table(spark, sf_dir, "facts").where(F.col("predicate").isin(*REPEATED)))


def p4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions the currency reasoning learns from, and which of them are precedences."""
    return survivors.precedence(survivors.transitions(read_table(spark, sf_dir, "facts").where(F.col("predicate").isin(*REPEATED))))


def p4_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of the fields that change, per group, and what settled it."""
    return survivors.latest_values(read_table(spark, sf_dir, "facts").where(F.col("predicate").isin(*REPEATED)))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec, text) of the utterances and of the turns in the payloads."""
    said = read_table(spark, sf_dir, "utterances").select(F.lit("utterances").alias("src"), F.col("id").alias("rec"), "text")
    turns = nested.turn_rows(nested.session_rows(spread(read_table(spark, sf_dir, "demo_user"))))
    rec = F.concat_ws("/", *[F.col(c).cast("string") for c in ("record_id", "session_pos", "turn_pos")])
    return said.unionByName(turns.select(F.lit("demo_user").alias("src"), rec.alias("rec"), "text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal datum by text, kind and number."""
    return pii.spans(_texts(spark, sf_dir), ["src", "rec"]).select("src", "rec", "kind", "span_no").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with placeholders."""
    return pii.redact(_texts(spark, sf_dir).distinct(), ["src", "rec"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode_ids(read_table(spark, sf_dir, "documents"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("cluster", F.when(F.length("text") > 0, F.xxhash64("text")).otherwise(0))
    return cut(encode.count_tokens(docs, extra=("source", "cluster")).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size"), "source", "cluster"), "sizes")


def p9_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, measured in tokens, in containers of each capacity."""
    return packing.pack(_sizes(spark, sf_dir), read_table(spark, sf_dir, "token_budgets")).drop("source", "cluster")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing loses, overfills and crowds with copies: nothing."""
    items, budgets = _sizes(spark, sf_dir), read_table(spark, sf_dir, "token_budgets")
    return packing.report(cut(packing.pack(items, budgets), "bins"), items, budgets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are lists, tables or junk."""
    return quality.kinds(read_table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every document with their tail probabilities and the outlier score."""
    return quality.scored(cut(quality.statistics(read_table(spark, sf_dir, "documents")), "statistics"))


def p10_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks alone, of the lengths of all documents within the language given."""
    docs = read_table(spark, sf_dir, "documents").where("n_chars is not null").select(F.coalesce("lang", F.lit("xx")).alias("language"), "n_chars")
    return quality.tail_table(docs, ("n_chars",))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_records": p4_records, "p4_gathered": p4_gathered, "p4_order": p4_order, "p4_latest": p4_latest, "p6_found": p6_found, "p6_redacted": p6_redacted,
        "p8_ids": p8_ids, "p9_bins": p9_bins, "p9_report": p9_report, "p10_found": p10_found, "p10_scores": p10_scores, "p10_ranks": p10_ranks,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p4_found": P4_SQL, "p4_gathered": P4_GATHERED_SQL, "p4_order": P4_ORDER_SQL, "p4_latest": P4_LATEST_SQL, "p10_ranks": P10_RANKS_SQL, "p9_report": P9_REPORT_SQL}


P9_REPORT_SQL = "SELECT budget_id, (SELECT count(*) FROM documents) AS items, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS crowded FROM token_budgets WHERE capacity >= 1"
P10_RANKS_SQL = """
WITH d AS (SELECT coalesce(lang, 'xx') AS language, n_chars AS v FROM documents WHERE n_chars IS NOT NULL),
g AS (SELECT language, v, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT '*', v, count(*) FROM d GROUP BY ALL)
SELECT language, 'n_chars' AS stat, CAST(v AS DOUBLE) AS value, CAST(sum(n) OVER (PARTITION BY language ORDER BY v) AS BIGINT) AS upto,
  CAST(sum(n) OVER (PARTITION BY language ORDER BY v DESC) AS BIGINT) AS beyond, CAST(sum(n) OVER (PARTITION BY language) AS BIGINT) AS total FROM g
"""
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '', 'g')"
P1_SQL = f"""
WITH r AS (
  SELECT session_id, turn_number, id, {_TRIM.format('speaker')} AS sp, {_TRIM.format('text')} AS tx,
    CASE lower({_TRIM.format("coalesce(speaker, 'user')")}) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant'
      WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'system' THEN 'system' END AS role
  FROM turns WHERE session_id IS NOT NULL),
t AS (
  SELECT session_id, turn_number, sp, tx, min(id) AS turn_id, min(role) AS role,
    bool_and(role IS NOT NULL AND coalesce(tx, '') <> '' AND turn_number IS NOT NULL) AS ok
  FROM r GROUP BY ALL),
u AS (SELECT *, lead(role) OVER (PARTITION BY session_id ORDER BY turn_number) AS follows FROM t),
s AS (
  SELECT session_id, min(turn_number) AS lo FROM u GROUP BY session_id
  HAVING bool_and(ok) AND count(*) = count(DISTINCT turn_number) AND min(turn_number) IN (0, 1)
    AND max(turn_number) - min(turn_number) + 1 = count(*) AND bool_or(role = 'user')
    AND bool_and(role <> 'user' OR coalesce(follows, '') = 'assistant'))
SELECT session_id, CAST(turn_number - lo AS INTEGER) AS pos, turn_id, role AS speaker_role FROM u JOIN s USING (session_id)
"""
P4_SQL = r"""
WITH f AS (
  SELECT DISTINCT id, subject, predicate, polarity, confidence, valid_from, source_sessions, evidence,
    replace(regexp_replace(trim(regexp_replace(lower(strip_accents(object)), '[^\p{L}\p{N}]+', ' ', 'g')), '^(a|an|the)\s+', ''), ' ', '') AS k
  FROM facts WHERE predicate IN ('likes','has','learning','allergic_to')),
r AS (
  SELECT *, row_number() OVER (PARTITION BY subject, predicate, polarity, k ORDER BY confidence DESC NULLS LAST,
      coalesce(len(list_distinct(source_sessions)), 0) DESC, valid_from DESC NULLS LAST, id) AS n
  FROM f WHERE subject IS NOT NULL AND polarity IS NOT NULL AND k <> ''),
g AS (
  SELECT subject, predicate, polarity, k, min(id) AS group_id, arg_min(id, n) AS survivor_id,
    coalesce(arg_min(id, n) FILTER (trim(evidence) <> ''), '') AS evidence_id, CAST(count(*) AS INTEGER) AS n_members
  FROM r GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT subject, predicate, polarity, k, CAST(count(DISTINCT x) AS INTEGER) AS m FROM (SELECT subject, predicate, polarity, k, unnest(source_sessions) AS x FROM r) GROUP BY ALL)
SELECT group_id, survivor_id, evidence_id, n_members, coalesce(m, 0) AS n_sources
FROM g LEFT JOIN s USING (subject, predicate, polarity, k)
"""
_GROUPED = r"""f AS (
  SELECT DISTINCT id, subject, predicate, polarity, valid_from, source_sessions, evidence, qualifier, extraction_method,
    replace(regexp_replace(trim(regexp_replace(lower(strip_accents(object)), '[^\p{L}\p{N}]+', ' ', 'g')), '^(a|an|the)\s+', ''), ' ', '') AS k
  FROM facts WHERE predicate IN ('likes','has','learning','allergic_to') AND subject IS NOT NULL AND polarity IS NOT NULL),
g AS (SELECT subject, predicate, polarity, k, min(id) AS group_id FROM f WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT id) > 1)"""
P4_GATHERED_SQL = f"""WITH {_GROUPED}
SELECT DISTINCT group_id, 'source_sessions' AS field, s AS value FROM (SELECT subject, predicate, polarity, k, unnest(source_sessions) AS s FROM f) JOIN g USING (subject, predicate, polarity, k) WHERE s IS NOT NULL
UNION ALL SELECT DISTINCT group_id, 'evidence', evidence FROM f JOIN g USING (subject, predicate, polarity, k) WHERE trim(evidence) <> ''
"""
_FIELDS = "(SELECT *, 'qualifier' AS field, qualifier AS v FROM {0} WHERE trim(qualifier) <> '' UNION ALL SELECT *, 'extraction_method', extraction_method FROM {0} WHERE trim(extraction_method) <> '')"
_ORDER = """t AS (
  SELECT field, v AS earlier, w AS later, count(*) AS n FROM (
    SELECT field, v, lead(v) OVER (PARTITION BY field, subject, predicate ORDER BY valid_from, id) AS w
    FROM (SELECT DISTINCT subject, predicate, id, valid_from, field, v FROM {0} WHERE valid_from IS NOT NULL))
  WHERE v <> w GROUP BY ALL),
o AS (
  SELECT t.field, t.earlier, t.later, t.n, coalesce(b.n, 0) AS back, t.n >= 3 AND t.n - coalesce(b.n, 0) >= 2.0 * sqrt(t.n + coalesce(b.n, 0)) AS precedes
  FROM t LEFT JOIN t b ON b.field = t.field AND b.earlier = t.later AND b.later = t.earlier)"""
_REPEATED = "(SELECT * FROM facts WHERE predicate IN ('likes','has','learning','allergic_to'))"
P4_ORDER_SQL = f"WITH {_ORDER.format(_FIELDS.format(_REPEATED))} SELECT * FROM o"
P4_LATEST_SQL = f"""WITH RECURSIVE {_ORDER.format(_FIELDS.format(_REPEATED))}, {_GROUPED},
p AS (SELECT field, earlier, later FROM o WHERE precedes UNION SELECT p.field, p.earlier, o.later FROM p JOIN o ON o.field = p.field AND o.earlier = p.later AND o.precedes),
c AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.field = p.field AND q.earlier = p.later AND q.later = p.earlier)),
m AS (SELECT group_id, field, v, id, valid_from FROM {_FIELDS.format('f')} JOIN g USING (subject, predicate, polarity, k)),
d AS (SELECT group_id, field, arg_max(v, (valid_from, id)) AS dated FROM m WHERE valid_from IS NOT NULL GROUP BY ALL),
u AS (SELECT group_id, field, v, count(DISTINCT id) AS rows FROM m WHERE valid_from IS NULL GROUP BY ALL),
a AS (SELECT u.*, d.dated FROM u LEFT JOIN d USING (group_id, field) WHERE d.dated IS NULL OR EXISTS (SELECT 1 FROM c WHERE c.field = u.field AND c.earlier = d.dated AND c.later = u.v)),
b AS (SELECT a.*, EXISTS (SELECT 1 FROM c JOIN a x ON x.v = c.later WHERE c.field = a.field AND c.earlier = a.v AND x.field = a.field AND x.group_id = a.group_id) AS below FROM a),
s AS (SELECT group_id, field, arg_min(v, (-rows, v)) FILTER (NOT below) AS top, bool_or(below) AS ordered FROM b GROUP BY ALL)
SELECT group_id, field, coalesce(top, dated) AS value, CASE WHEN top IS NULL THEN 'date' WHEN dated IS NOT NULL OR ordered THEN 'order' ELSE 'rows' END AS decided
FROM d FULL JOIN s USING (group_id, field)
"""
