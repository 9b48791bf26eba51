"""Queries of the engine's own operators over whole tables, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.functions.text import spaced_key
from strata.operators import budget, facts, graph, predicates as p, routing, search
from strata.operators.extraction import extract
from strata.operators.timestamps import human_date, to_iso
from strata.plans import answer as plan
from strata.plans import evaluate, intake
from strata.session import cut, read_table
from strata.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_table(spark, d, "Fact")


# ---- predicates, scans ---------------------------------------------------------------------------
_F = "(SELECT DISTINCT ON (id) * FROM facts)"


@query("match_ordered", f"SELECT id, predicate, object, confidence FROM {_F} WHERE predicate = 'works_at' AND is_current ORDER BY confidence DESC NULLS LAST, id LIMIT 200 OFFSET 5")
def _match(s, d):
    f = _facts(s, d).select("id", "predicate", "object", "confidence", "is_current")
    return p.match(f, {"predicate": "works_at", "is_current": True}, [("confidence", "desc"), ("id", "asc")], 200, 5).drop("is_current")


_PREDS = {
    "pred_eq": ({"polarity": p.eq("negative")}, "polarity = 'negative'"),
    "pred_eq_null": ({"qualifier": None}, "qualifier IS NULL"),
    "pred_ne": ({"extraction_method": p.ne("llm-extract")}, "extraction_method <> 'llm-extract'"),
    "pred_in": ({"predicate": p.in_(["has", "likes"])}, "predicate IN ('has', 'likes')"),
    "pred_in_empty": ({"predicate": p.in_([])}, "false"),
    "pred_range": ({"confidence": p.gte(0.6)}, "confidence >= 0.6"),
    "pred_lt": ({"confidence": p.lt(0.6)}, "confidence < 0.6"),
    "pred_gt_lte": ({"confidence": lambda c: p.gt(0.55)(c) & p.lte(0.8)(c)}, "confidence > 0.55 AND confidence <= 0.8"),
    "pred_null": ({"evidence": p.is_null()}, "evidence IS NULL"),
    "pred_not_null": ({"valid_from": p.not_null()}, "valid_from IS NOT NULL"),
    "pred_contains": ({"object": p.contains("An O")}, "contains(lower(object), 'an o')"),
}
for _n, (_tests, _cond) in _PREDS.items():
    query(_n, f"SELECT id, predicate, object FROM {_F} WHERE {_cond}")(lambda s, d, t=_tests: p.where(_facts(s, d), t).select("id", "predicate", "object"))


@query("count_filtered", f"SELECT count(*) AS n FROM {_F} WHERE is_current AND polarity = 'positive'")
def _count(s, d):
    return p.where(_facts(s, d), {"is_current": True, "polarity": "positive"}).agg(F.count(F.lit(1)).alias("n"))


@query("point_lookup", f"SELECT f.id, f.object FROM {_F} f WHERE f.id IN (SELECT min(id) FROM facts GROUP BY predicate)")
def _lookup(s, d):
    ids = _t(s, d, "facts").groupBy("predicate").agg(F.min("id").alias("id")).select("id")
    return _facts(s, d).join(ids, "id", "left_semi").select("id", "object")


@query("status_counters", f"SELECT count(*) FILTER (is_current) AS current_facts, count(*) FILTER (NOT is_current) AS superseded_facts, count(*) FILTER (polarity = 'negative') AS negative_facts FROM {_F}")
def _status(s, d):
    return _facts(s, d).agg(F.count_if("is_current").alias("current_facts"), F.count_if(~F.col("is_current")).alias("superseded_facts"), F.count_if(F.col("polarity") == "negative").alias("negative_facts"))


# ---- graph ---------------------------------------------------------------------------------------
_CHAIN = "SELECT session_id, turn_number, id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM (SELECT DISTINCT session_id, turn_number, id FROM turns WHERE session_id IS NOT NULL AND turn_number IS NOT NULL) WINDOW w AS (PARTITION BY session_id ORDER BY turn_number, id)"
_EDGES = f"""
  SELECT DISTINCT session_id AS start_id, 'HAS_TURN' AS type, id AS end_id FROM turns WHERE session_id IS NOT NULL
  UNION ALL SELECT DISTINCT turn_id, 'HAS_UTTERANCE', id FROM utterances WHERE turn_id IS NOT NULL
  UNION ALL SELECT DISTINCT id, 'NEXT', next_id FROM ({_CHAIN}) WHERE next_id IS NOT NULL
  UNION ALL SELECT DISTINCT id, 'DERIVED_FROM', s FROM (SELECT id, unnest(source_sessions) AS s FROM facts) WHERE s IS NOT NULL"""
_NODES = " UNION ALL ".join(f"SELECT DISTINCT id, '{label}' AS label FROM {t}" for label, t in graph.TABLES.items())


@query("node_edge_stats", f"""WITH n AS ({_NODES}), e AS ({_EDGES})
SELECT 'label' AS kind, label AS name, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM e GROUP BY type
UNION ALL SELECT 'layer', CASE WHEN label IN ('Session','Turn','Utterance') THEN 'episodic' ELSE 'semantic' END, count(*) FROM n GROUP BY 2""")  # fmt: skip
def _stats(s, d):
    return graph.stats(graph.all_nodes(s, d), graph.all_edges(s, d))


@query("turn_chain", _CHAIN)
def _turn_chain(s, d):
    return graph.turn_chain(_t(s, d, "turns"))


@query("session_chain", "SELECT user_id, id, lag(id) OVER (PARTITION BY user_id ORDER BY start_time, id) AS previous_id FROM (SELECT DISTINCT user_id, id, start_time FROM sessions)")
def _session_chain(s, d):
    return graph.session_chain(_t(s, d, "sessions"))


_ANCHORS = "(SELECT DISTINCT id FROM sessions WHERE session_number = 1)"


def _anchors(s, d):
    return _t(s, d, "sessions").where("session_number = 1").select("id")


for _dir, _sql in {
    "out": f"SELECT a.id AS anchor_id, e.type, e.end_id AS other_id FROM {_ANCHORS} a JOIN e ON e.start_id = a.id WHERE e.type IN ('HAS_TURN','DERIVED_FROM')",
    "in": f"SELECT a.id AS anchor_id, e.type, e.start_id AS other_id FROM {_ANCHORS} a JOIN e ON e.end_id = a.id WHERE e.type IN ('HAS_TURN','DERIVED_FROM')",
    "both": f"SELECT a.id AS anchor_id, e.type, e.end_id AS other_id FROM {_ANCHORS} a JOIN e ON e.start_id = a.id WHERE e.type IN ('HAS_TURN','DERIVED_FROM') UNION ALL SELECT a.id, e.type, e.start_id FROM {_ANCHORS} a JOIN e ON e.end_id = a.id WHERE e.type IN ('HAS_TURN','DERIVED_FROM')",
}.items():
    query(f"expand_{_dir}", f"WITH e AS ({_EDGES}) {_sql}")(lambda s, d, way=_dir: graph.expand(graph.all_edges(s, d), _anchors(s, d), ["HAS_TURN", "DERIVED_FROM"], way))


@query("expand_filtered", f"WITH e AS ({_EDGES}) SELECT a.id AS anchor_id, e.type, e.start_id AS other_id FROM {_ANCHORS} a JOIN e ON e.end_id = a.id WHERE e.type = 'DERIVED_FROM' AND e.start_id IN (SELECT id FROM facts WHERE is_current AND confidence > 0.6)")
def _expand_filtered(s, d):
    return graph.expand(graph.all_edges(s, d), _anchors(s, d), ["DERIVED_FROM"], "in", _facts(s, d), {"is_current": True, "confidence": p.gt(0.6)})


@query("bounded_paths", f"""WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE type IN ('HAS_TURN','HAS_UTTERANCE')),
p AS (SELECT id AS source_id, 0 AS depth, [id] AS nodes FROM (SELECT DISTINCT id FROM sessions)
  UNION ALL SELECT p.source_id, p.depth + 1, list_append(p.nodes, e.end_id) FROM p JOIN e ON e.start_id = p.nodes[-1] WHERE p.depth < 3 AND NOT list_contains(p.nodes, e.end_id)),
r AS (SELECT source_id, depth, nodes, row_number() OVER (PARTITION BY source_id ORDER BY depth, nodes) AS n FROM p WHERE depth > 0)
SELECT source_id, depth, nodes FROM r WHERE n <= 40 ORDER BY source_id, depth, nodes LIMIT 400""")  # fmt: skip
def _paths(s, d):
    return graph.paths(graph.all_edges(s, d), _t(s, d, "sessions").select("id"), ["HAS_TURN", "HAS_UTTERANCE"], "out", 3, 40, 400)


@query("session_hydrate", """SELECT u.id, CASE WHEN s.session_number IS NOT NULL THEN 'session ' || s.session_number || ' (' || strftime(s.start_time, '%Y-%m-%d') || ')' ELSE 'session unknown date' END AS label
FROM (SELECT DISTINCT id, session_id FROM utterances) u LEFT JOIN (SELECT DISTINCT ON (id) id, session_number, start_time FROM sessions) s ON s.id = u.session_id""")  # fmt: skip
def _hydrate(s, d):
    u = _t(s, d, "utterances").select("id", "session_id").distinct()
    ses = _t(s, d, "sessions").dropDuplicates(["id"]).select(F.col("id").alias("session_id"), plan.session_label().alias("label"))
    return u.join(ses, "session_id", "left").select("id", F.coalesce("label", F.lit("session unknown date")).alias("label"))


@query("merge_edges", f"""WITH e AS (SELECT * FROM ({_EDGES}) WHERE type = 'HAS_TURN'), n AS (SELECT DISTINCT session_id AS start_id, 'HAS_TURN' AS type, turn_id AS end_id FROM utterances WHERE session_id IS NOT NULL AND turn_id IS NOT NULL)
SELECT * FROM e UNION SELECT * FROM n""")  # fmt: skip
def _merge_edges(s, d):
    e = graph.all_edges(s, d).where("type = 'HAS_TURN'")
    new = _t(s, d, "utterances").where("session_id is not null and turn_id is not null").select(F.col("session_id").alias("start_id"), F.lit("HAS_TURN").alias("type"), F.col("turn_id").alias("end_id"))
    return graph.merge_edges(e, new)


@query("upsert_edges", "SELECT user_id AS start_id, 'LAST' AS type, 'x' AS end_id, arg_max(id, (start_time, id)) AS session FROM (SELECT DISTINCT user_id, id, start_time FROM sessions) GROUP BY user_id")
def _upsert_edges(s, d):
    ses = _t(s, d, "sessions").select("user_id", "id", "start_time").distinct()
    rows = ses.select(F.col("user_id").alias("start_id"), F.lit("LAST").alias("type"), F.lit("x").alias("end_id"), F.col("id").alias("session"), "start_time")
    late = rows.groupBy("start_id", "type", "end_id").agg(F.max_by("session", F.struct("start_time", "session")).alias("session"))
    old = late.withColumn("session", F.lit("none"))
    return graph.upsert_edges(old, late.select("start_id", "type", "end_id", "session"), F.lit(1))


_CANON = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(array_to_string(list_transform(string_split(coalesce(name, ''), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '[\s ]+', ' ', 'g'), '^ ?(a|an|the) ', ''))"""


@query("merge_nodes", """WITH a AS (SELECT DISTINCT ON (id) id, mention_count FROM entities), k AS (SELECT id, mention_count FROM a WHERE mention_count > 3)
SELECT a.id, a.mention_count + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS mention_count FROM a LEFT JOIN k USING (id)""")  # fmt: skip
def _merge_nodes(s, d):
    ents = graph.node_table(s, d, "Entity").select("id", "mention_count")
    return graph.merge_nodes(ents, ents.where("mention_count > 3"), "id", {"mention_count": F.col("mention_count") + 1})


@query("set_props", f"SELECT id, CASE WHEN predicate = 'has' THEN 0.5 ELSE confidence END AS confidence FROM {_F}")
def _set_props(s, d):
    f = _facts(s, d)
    return graph.set_props(f.select("id", "confidence"), f.where("predicate = 'has'").select("id", F.lit(0.5).alias("confidence")))


@query("graph_sample", f"""WITH n AS ({_NODES}), e AS ({_EDGES}), k AS (SELECT id, label FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 40)
SELECT start_id, type, end_id FROM e WHERE start_id IN (SELECT id FROM k) AND end_id IN (SELECT id FROM k)""")  # fmt: skip
def _sample(s, d):
    return graph.sample(graph.all_nodes(s, d), graph.all_edges(s, d), 200)[1]


# ---- text ----------------------------------------------------------------------------------------
_U = "(SELECT DISTINCT ON (id) id, text, timestamp, session_id, speaker FROM utterances)"
_STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)
_SPELL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lexical.SPELLING.items()) + "}"
_TOK = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9+#]+'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x))"


def _utterances(s, d):
    return graph.node_table(s, d, "Utterance")


@query("utterance_sentences", """SELECT id, i - 1 AS n, trim(s, e' \\t\\r\\n') AS sentence FROM (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
  SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n+', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, e' \\t\\r\\n')), lambda x: x <> '') AS l FROM (SELECT DISTINCT id, text FROM utterances WHERE text IS NOT NULL)))""")  # fmt: skip
def _sentences(s, d):
    return _t(s, d, "utterances").select("id", "text").where("text is not null").distinct().select("id", F.posexplode(lexical.sentences(F.col("text"))).alias("n", "sentence"))


@query("content_tokens", f"SELECT id, {_TOK.format('text')} AS tokens FROM {_U}")
def _tokens(s, d):
    return _utterances(s, d).select("id", lexical.content_tokens(F.col("text")).alias("tokens"))


_STEM = f"""(SELECT w, left(coalesce(({_SPELL})[c], c), 5) AS stem FROM (SELECT w, CASE WHEN length(b) > 3 AND b LIKE '%s' AND b NOT LIKE '%ss' THEN left(b, length(b) - 1) ELSE b END AS c FROM (
  SELECT w, coalesce(({_SPELL})[w], w) AS b FROM (SELECT DISTINCT unnest({_TOK.format('text')}) AS w FROM documents))))"""


@query("word_stems", f"SELECT w, stem FROM {_STEM}")
def _stems(s, d):
    words = _t(s, d, "documents").select(F.explode(lexical.content_tokens(F.col("text"))).alias("w")).distinct()
    return words.select("w", lexical.stem(F.col("w")).alias("stem"))


_QWORDS = ["fact", "table", "slow", "nightly", "import", "coffee", "42"]


@query("idf_weights", f"SELECT q.token, count(u.id) AS df, round(ln((t.n + 1) / (count(u.id) + 1)) + 1, 6) AS weight FROM (SELECT unnest({_QWORDS}) AS token) q CROSS JOIN (SELECT count(*) AS n FROM {_U}) t LEFT JOIN {_U} u ON contains(lower(u.text), q.token) GROUP BY q.token, t.n")
def _idf(s, d):
    words = s.createDataFrame([(w,) for w in _QWORDS], "token string")
    return search.idf_weights(_utterances(s, d), words).withColumn("weight", F.round("weight", 6))


@query("overlap_scores", f"SELECT id, round(len(list_filter(['fact', 'table', 'night', 'impor'], lambda q: list_contains(list_transform({_TOK.format('text')}, lambda w: left(CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END, 5)), q))) / 4.0, 6) AS score FROM {_U}")
def _overlap(s, d):
    q = F.array(*[F.lit(w) for w in ("fact", "table", "nightly", "import")])
    return _utterances(s, d).select("id", F.round(lexical.overlap(q, lexical.stems(F.col("text"))), 6).alias("score"))


_BM25Q = {"q1": ["nightly", "import", "slow"], "q2": ["allergic", "sesame"], "q3": ["rue", "flat"]}
_BM25V = ", ".join(f"('{q}', '{t}')" for q, ts in _BM25Q.items() for t in ts)


@query("bm25_top", f"""WITH w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#]+') AS ws FROM {_U}),
s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w), p AS (SELECT id, len(ws) AS l, unnest(ws) AS term FROM w),
tf AS (SELECT id, l, term, count(*) AS tf FROM p WHERE term IN (SELECT t FROM (VALUES {_BM25V}) v(q, t)) GROUP BY ALL),
idf AS (SELECT term, greatest(ln(((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf GROUP BY term),
r AS (SELECT v.q AS query_id, tf.id, round(sum(idf.idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.l / (SELECT mean FROM s)))), 6) AS score FROM tf JOIN idf USING (term) JOIN (VALUES {_BM25V}) v(q, t) ON v.t = tf.term GROUP BY ALL)
SELECT query_id, id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 60""")  # fmt: skip
def _bm25(s, d):
    q = s.createDataFrame(list(_BM25Q.items()), "query_id string, terms array<string>")
    return search.bm25(_utterances(s, d).select("id", "text"), q).withColumn("score", F.round("score", 6))


@query("vector_top", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, round(greatest(-1, least(1, list_dot_product(e, qe))), 6) AS similarity FROM v CROSS JOIN q)
SELECT query_id, vec_id, similarity, CASE WHEN similarity <= 0.4 THEN 0.0 ELSE round(least(1.0, (similarity - 0.4) / 0.3), 6) END AS grounding FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")  # fmt: skip
def _vectors(s, d):
    v = _t(s, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = search.vector_top_k(v, q, limit=10).withColumn("similarity", F.round("similarity", 6))
    return top.select("query_id", "vec_id", "similarity", F.round(search.grounding(F.col("similarity")), 6).alias("grounding"))


@query("canonical_names", f"SELECT DISTINCT name, {_CANON} AS canonical FROM entities WHERE name IS NOT NULL")
def _canonical(s, d):
    return _t(s, d, "entities").where("name is not null").select("name", lexical.canonical_name(F.col("name")).alias("canonical")).distinct()


@query("truncated", "SELECT id, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(left(text, 39), e' \\t\\n\\r') || '…' END AS text, CASE WHEN text = '' THEN 0 ELSE greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) END AS tokens FROM (SELECT DISTINCT id, text FROM utterances WHERE text IS NOT NULL)")
def _truncate(s, d):
    return _t(s, d, "utterances").where("text is not null").select("id", "text").distinct().select("id", lexical.truncate(F.col("text"), 40).alias("text"), lexical.estimated_tokens(F.col("text")).alias("tokens"))


_BASES = " ".join(f"WHEN p = '{b}' OR starts_with(p, '{b}_') THEN '{b}'" for b in lexical.PREDICATE_BASES)
_FUNC = " OR ".join(f"starts_with(split_part(predicate, '@', 1), '{b}')" for b in lexical.FUNCTIONAL_PREFIXES)


@query("predicate_parts", f"SELECT predicate, base, CASE WHEN p = base THEN '' ELSE substr(p, length(base) + 2) END AS category, functional FROM (SELECT predicate, p, CASE {_BASES} ELSE p END AS base, functional FROM (SELECT DISTINCT predicate, split_part(predicate, '@', 1) AS p, {_FUNC} AS functional FROM facts))")
def _parts(s, d):
    preds = _t(s, d, "facts").select("predicate").distinct()
    b = lexical.base_and_category(F.col("predicate"))
    return preds.select("predicate", b["base"].alias("base"), b["category"].alias("category"), lexical.is_functional(F.col("predicate")).alias("functional"))


def _case(table: dict[str, str]) -> str:
    return " ".join(f"WHEN base = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items())


@query("rendered_facts", f"""WITH b AS (SELECT id, subject, object, qualifier, polarity, is_current, p, CASE {_BASES} ELSE p END AS base FROM (SELECT *, split_part(predicate, '@', 1) AS p FROM {_F})),
t AS (SELECT *, CASE WHEN polarity = 'negative' THEN CASE {_case(lexical.STATED_NOT)} ELSE '{{s}} does not ' || replace(base, '_', ' ') || ' {{o}}' END
  WHEN NOT is_current THEN CASE {_case(lexical.STATED_PAST)} ELSE '{{s}} ' || replace(base, '_', ' ') || ' {{o}}' END ELSE CASE {_case(lexical.STATED)} ELSE '{{s}} ' || replace(base, '_', ' ') || ' {{o}}' END END AS tpl,
  CASE WHEN p = base THEN 'one' ELSE replace(substr(p, length(base) + 2), '_', ' ') END AS cat FROM b)
SELECT id, trim(regexp_replace(replace(replace(replace(tpl, '{{s}}', subject), '{{cat}}', cat), '{{o}}', coalesce(object, '')) || CASE WHEN coalesce(qualifier, '') = '' THEN '' ELSE ' (for ' || qualifier || ')' END, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS sentence FROM t""")  # fmt: skip
def _render(s, d):
    return _facts(s, d).select("id", lexical.rendered_fact(F.col("subject"), F.col("predicate"), F.col("object"), F.col("qualifier"), F.col("polarity") == "negative", ~F.col("is_current")).alias("sentence"))


def _hits(cues: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(l, '{c}') AS INTEGER)" for c in cues) + ")"


_SC = {k: f"{_hits(v)} * {lexical.CUE_WEIGHTS[k]}" for k, v in lexical.QUERY_CUES.items()}


@query("classified", f"""SELECT id, CASE WHEN t + pr + fa + pc = 0 THEN 'factual' WHEN t >= pr AND t >= fa AND t >= pc THEN 'temporal' WHEN pr >= fa AND pr >= pc THEN 'preference' WHEN fa >= pc THEN 'factual' ELSE 'procedural' END AS query_type,
CASE WHEN t + pr + fa + pc = 0 THEN 0.25 ELSE round(greatest(t, pr, fa, pc) / (t + pr + fa + pc), 3) END AS confidence, history, cue FROM (
SELECT id, CAST({_SC['temporal']} AS DOUBLE) AS t, CAST({_SC['preference']} AS DOUBLE) AS pr, CAST({_SC['factual']} AS DOUBLE) AS fa, CAST({_SC['procedural']} AS DOUBLE) AS pc, {_hits(lexical.HISTORY_CUES)} > 0 AS history,
CASE WHEN {_hits(lexical.CORRECTION_CUES)} > 0 THEN 'correction' WHEN {_hits(lexical.UPDATE_CUES)} > 0 THEN 'update' ELSE '' END AS cue FROM (SELECT id, lower(coalesce(text, '')) AS l FROM {_U}))""")  # fmt: skip
def _classify(s, d):
    u = _utterances(s, d).select("id", lexical.classify(F.col("text")).alias("c"), lexical.wants_history(F.col("text")).alias("history"), lexical.cue_of(F.col("text")).alias("cue"))
    return u.select("id", "c.query_type", F.round("c.confidence", 3).alias("confidence"), "history", "cue")


_NAMES = "(SELECT DISTINCT s AS session_id, lower(trim(object)) AS name FROM (SELECT unnest(source_sessions) AS s, object FROM facts) WHERE s IS NOT NULL AND trim(object) <> '' UNION SELECT DISTINCT id, 'user' FROM sessions WHERE session_number = 1)"


@query("mentions", f"SELECT DISTINCT u.id AS utterance_id, n.name AS canonical_name FROM {_U} u JOIN {_NAMES} n ON n.session_id = u.session_id AND (n.name = 'user' OR contains(lower(coalesce(u.text, '')), n.name))")
def _mentions(s, d):
    """Every utterance with the names its session is known for."""
    known = _t(s, d, "facts").select(F.explode("source_sessions").alias("session_id"), F.lower(F.trim("object")).alias("canonical_name")).where("session_id is not null and canonical_name <> ''")
    own = _t(s, d, "sessions").where("session_number = 1").select(F.col("id").alias("session_id"), F.lit("user").alias("canonical_name"))
    return intake.mention_edges(_utterances(s, d).where("session_id is not null"), known.unionByName(own).distinct(), ["session_id"])


@query("evidence_utterances", f"""WITH f AS (SELECT DISTINCT id AS fact_id, s AS session_id, lower(trim(coalesce(evidence, ''))) AS e FROM (SELECT id, evidence, unnest(source_sessions) AS s FROM {_F})),
u AS (SELECT DISTINCT ON (id) id, session_id, utterance_number AS n, lower(trim(coalesce(text, ''))) AS t FROM utterances WHERE session_id IS NOT NULL),
p AS (SELECT f.fact_id, f.session_id, u.id, CASE WHEN f.e <> '' AND u.t = f.e THEN 0 WHEN f.e <> '' AND contains(u.t, f.e) THEN 1 ELSE 2 END AS r, u.n FROM f JOIN u USING (session_id))
SELECT fact_id || '/' || session_id AS fact_id, arg_min(id, (r, n, id)) AS utterance_id FROM p GROUP BY fact_id, session_id""")  # fmt: skip
def _proof(s, d):
    """The utterance a fact rests on, in each of its sessions."""
    f = _facts(s, d).select("id", "evidence", F.explode("source_sessions").alias("session_id")).where("session_id is not null").distinct()
    said = graph.node_table(s, d, "Utterance").where("session_id is not null")
    return intake.evidence_utterances(f.withColumn("id", F.concat_ws("/", "id", "session_id")), said, ["session_id"])


# ---- facts ---------------------------------------------------------------------------------------
_ST = f"""SELECT id, subject, predicate, lower(trim(object)) AS object, polarity, confidence, epoch_us(recorded_at) AS seq, CASE WHEN starts_with(extraction_method, 'llm') THEN 'update' ELSE '' END AS cue,
 {_FUNC} AS functional FROM {_F} WHERE object IS NOT NULL AND subject IS NOT NULL"""
_MERGED = f"""WITH s AS (SELECT *, CASE WHEN functional THEN '' ELSE object END AS scope FROM ({_ST})),
a AS (SELECT subject, predicate, scope, arg_min(id, (seq, id)) AS aid, arg_min(object, (seq, id)) AS aobj, arg_min(polarity, (seq, id)) AS apol FROM s GROUP BY ALL),
m AS (SELECT s.*, aid AS anchor_id, CASE WHEN id = aid THEN 'current' WHEN object = aobj AND polarity = apol THEN 'reinforce' WHEN object = aobj THEN 'correction' WHEN cue = 'update' THEN 'update' ELSE 'contradiction' END AS outcome FROM s JOIN a USING (subject, predicate, scope))"""


def _merged(s, d) -> DataFrame:
    f = _facts(s, d).where("object is not null and subject is not null")
    st = f.select("id", "subject", "predicate", F.lower(F.trim("object")).alias("object"), "polarity", "confidence", F.unix_micros("recorded_at").alias("seq"), F.when(F.startswith("extraction_method", F.lit("llm")), "update").otherwise("").alias("cue"))
    return facts.merge_statements(st)


@query("fact_merge", f"{_MERGED} SELECT id, outcome, anchor_id FROM m")
def _fact_merge(s, d):
    return _merged(s, d).select("id", "outcome", "anchor_id")


@query("fact_reinforced", f"{_MERGED}, k AS (SELECT anchor_id AS id, count(*) AS k FROM m WHERE outcome = 'reinforce' GROUP BY 1) SELECT m.id, least(1.0, round(coalesce(confidence, 0.7) + coalesce(k, 0) * 0.1, 4)) AS confidence, outcome = 'current' AS is_current, coalesce(k, 0) + 1 AS times FROM m LEFT JOIN k USING (id) WHERE outcome <> 'reinforce'")
def _reinforced(s, d):
    return facts.merged_facts(_merged(s, d)).select("id", "confidence", "is_current", "times")


@query("conflicts", f"{_MERGED} SELECT anchor_id AS existing_id, id AS new_id, subject, predicate, outcome AS conflict_type FROM m WHERE outcome IN ('correction','update','contradiction')")
def _conflicts(s, d):
    return facts.conflicts(_merged(s, d))


@query("conflict_edges", f"{_MERGED}, c AS (SELECT id, anchor_id FROM m WHERE outcome IN ('correction','update','contradiction')) SELECT 'c-' || id AS start_id, 'INVOLVES' AS type, anchor_id AS end_id, 'existing' AS role FROM c UNION ALL SELECT 'c-' || id, 'INVOLVES', id, 'new' FROM c UNION ALL SELECT anchor_id, 'CONFLICTS_WITH', id, '' FROM c")
def _conflict_edges(s, d):
    return intake.conflict_edges(facts.conflicts(_merged(s, d)).withColumn("id", F.concat(F.lit("c-"), "new_id")))


@query("merge_counters", f"{_MERGED} SELECT predicate, count(*) FILTER (outcome <> 'reinforce') AS facts_created, count(*) FILTER (outcome = 'reinforce') AS facts_reinforced, count(*) FILTER (outcome IN ('correction','update','contradiction')) AS conflicts_detected FROM m GROUP BY predicate")
def _counters(s, d):
    return intake.counters(_merged(s, d), ["predicate"])


_AT, _NS, _CF = "coalesce(valid_from, TIMESTAMPTZ '1970-01-01 00:00:00+00')", "coalesce(len(list_distinct(source_sessions)), 0)", "coalesce(confidence, 0.0)"
_ORDER = {"recency": f"{_AT} DESC", "frequency": f"{_NS} DESC, {_AT} DESC", "confidence": f"{_CF} DESC, {_AT} DESC", "trust": f"(coalesce(extraction_method, '') <> 'llm-extract') DESC, {_NS} DESC, {_AT} DESC"}
for _pol, _o in _ORDER.items():
    query(f"winner_{_pol}", f"SELECT subject, predicate, id AS winner_id, n FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY {_o}, id) AS r, count(*) OVER (PARTITION BY subject, predicate) AS n FROM {_F} WHERE {_FUNC}) WHERE r = 1")(lambda s, d, pol=_pol: facts.slot_winners(_facts(s, d), pol))
    query(f"resolve_{_pol}", f"""{_MERGED}, c AS (SELECT id AS conflict_id, anchor_id, id AS new_id FROM m WHERE outcome IN ('correction','update','contradiction')),
 x AS (SELECT c.conflict_id, f.* FROM c JOIN {_F} f ON f.id IN (c.anchor_id, c.new_id)), r AS (SELECT conflict_id, id, row_number() OVER (PARTITION BY conflict_id ORDER BY {_o}, id) AS r FROM x)
 SELECT conflict_id, max(id) FILTER (r = 1) AS winner_id, max(id) FILTER (r = 2) AS loser_id FROM r GROUP BY conflict_id""")(lambda s, d, pol=_pol: facts.resolve_pairs(facts.conflicts(_merged(s, d)).select(F.col("new_id").alias("conflict_id"), "existing_id", "new_id"), _facts(s, d), pol))  # fmt: skip


@query("consolidated", f"""{_MERGED}, c AS (SELECT id AS conflict_id, anchor_id, seq FROM m WHERE outcome IN ('correction','update','contradiction')),
x AS (SELECT c.conflict_id, c.seq, f.id, {_AT} AS at_ FROM c JOIN {_F} f ON f.id IN (c.anchor_id, c.conflict_id)), r AS (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY at_ DESC, id) = 1 AS won FROM x),
l AS (SELECT id, arg_max(won, (seq, won)) AS won, bool_or(won) AS ever FROM r GROUP BY id)
SELECT f.id, coalesce(l.won, f.is_current) AS is_current, CASE WHEN ever THEN least(0.95, round(0.8 + 0.05 * {_NS}, 4)) ELSE confidence END AS confidence, CASE WHEN ever THEN 'consolidated' ELSE extraction_method END AS extraction_method FROM {_F} f LEFT JOIN l USING (id)""")  # fmt: skip
def _consolidated(s, d):
    c = facts.conflicts(_merged(s, d)).select(F.col("new_id").alias("conflict_id"), "existing_id", "new_id")
    pairs = c.join(_facts(s, d).select(F.col("id").alias("conflict_id"), F.unix_micros("recorded_at").alias("seq")), "conflict_id")
    return facts.consolidate(_facts(s, d), pairs, "recency", F.lit("2026-07-01T00:00:00Z").cast("timestamp"))[0].select("id", "is_current", "confidence", "extraction_method")


@query("duplicates_merged", f"""WITH c AS (SELECT * FROM {_F} WHERE is_current), g AS (SELECT subject, predicate, object, polarity, arg_min(id, ({_AT}, id)) AS keep_id, count(*) AS n, max(confidence) AS c FROM c GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT subject, predicate, object, polarity, count(DISTINCT x) AS m FROM (SELECT subject, predicate, object, polarity, unnest(source_sessions) AS x FROM c) GROUP BY ALL)
SELECT keep_id, subject, predicate, object, polarity, n, coalesce(m, 0) AS n_sources, round(least(1.0, greatest(coalesce(c, 0.0), 0.6 + 0.1 * coalesce(m, 0))), 4) AS confidence FROM g LEFT JOIN s USING (subject, predicate, object, polarity)""")  # fmt: skip
def _duplicates(s, d):
    return facts.merge_duplicates(_facts(s, d))


@query("fact_predecessor", f"""SELECT f.id, (SELECT arg_max(lower(o.object), (o.valid_from, lower(o.object))) FROM {_F} o WHERE o.subject = f.subject AND o.predicate = f.predicate AND o.valid_from < f.valid_from AND lower(o.object) IS DISTINCT FROM lower(f.object) AND o.object IS NOT NULL) AS previous_object
FROM {_F} f WHERE f.valid_from IS NOT NULL""")  # fmt: skip
def _predecessor(s, d):
    return facts.predecessors(_facts(s, d))


@query("fact_supersession", f"""{_MERGED}, c AS (SELECT id AS conflict_id, anchor_id FROM m WHERE outcome IN ('correction','update','contradiction')),
x AS (SELECT c.conflict_id, f.id, {_AT} AS at_ FROM c JOIN {_F} f ON f.id IN (c.anchor_id, c.conflict_id)), r AS (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY at_ DESC, id) AS r FROM x),
e AS (SELECT DISTINCT a.id AS w, b.id AS l FROM r a JOIN r b USING (conflict_id) WHERE a.r = 1 AND b.r = 2)
SELECT f.id, coalesce((SELECT list_sort(list(DISTINCT o.object)) FROM e JOIN {_F} o ON o.id = e.l WHERE e.w = f.id), []) AS supersedes, coalesce((SELECT list_sort(list(DISTINCT o.object)) FROM e JOIN {_F} o ON o.id = e.w WHERE e.l = f.id), []) AS superseded_by FROM {_F} f""")  # fmt: skip
def _supersession(s, d):
    f = _facts(s, d)
    pairs = facts.resolve_pairs(facts.conflicts(_merged(s, d)).select(F.col("new_id").alias("conflict_id"), "existing_id", "new_id"), f)
    return facts.supersession(f, pairs.select(F.col("winner_id").alias("start_id"), F.lit("SUPERSEDES").alias("type"), F.col("loser_id").alias("end_id")).distinct())


@query("entity_upserts", """WITH e AS (SELECT DISTINCT ON (id) * FROM entities), k AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key FROM e WHERE name IS NOT NULL)
SELECT key, count(*) AS mentions, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_min(entity_type, (first_seen, id)) FILTER (entity_type IS NOT NULL) AS entity_type, arg_min(name, (first_seen, id)) AS name FROM k GROUP BY 1""")  # fmt: skip
def _entities(s, d):
    e = graph.node_table(s, d, "Entity").where("name is not null").withColumn("key", spaced_key(F.col("name")))
    return intake.entity_upserts(e, ["key"])


@query("top_caps", f"SELECT subject, predicate, id, confidence FROM {_F} QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC NULLS LAST, id) <= 4")
def _caps(s, d):
    return search.top_k(_facts(s, d).select("subject", "predicate", "id", "confidence"), ["subject", "predicate"], [F.col("confidence").desc_nulls_last(), F.col("id").asc()], 4)


@query("slot_prune", f"WITH s AS (SELECT id, subject, predicate, CASE WHEN contains(lower(evidence), 'nightly') THEN 1.0 ELSE 0.0 END AS lexical FROM {_F}) SELECT id, lexical = 0 AS graph_linked FROM s WHERE lexical > 0 OR (subject, predicate) IN (SELECT (subject, predicate) FROM s WHERE lexical > 0)")
def _prune(s, d):
    sc = _facts(s, d).select(F.lit("q").alias("query_id"), "id", "subject", "predicate", F.when(F.coalesce(F.contains(F.lower("evidence"), F.lit("nightly")), F.lit(False)), 1.0).otherwise(0.0).alias("lexical"))
    return facts.slot_linked(sc).select("id", "graph_linked")


# ---- budgets -------------------------------------------------------------------------------------
@query("context_prefix", f"SELECT session_id, id, used FROM (SELECT session_id, id, sum(greatest(length(text) // 4, 1)) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS used FROM {_U} WHERE text IS NOT NULL AND session_id IS NOT NULL) WHERE used <= 60")
def _prefix(s, d):
    u = _utterances(s, d).where("text is not null and session_id is not null").select("session_id", "id", "timestamp", F.greatest(F.floor(F.length("text") / 4), F.lit(1)).cast("bigint").alias("cost"))
    return budget.prefix(u, ["session_id"], [F.col("timestamp").asc(), F.col("id").asc()], "cost", 60).select("session_id", "id", "used")


@query("greedy_fill", f"""WITH RECURSIVE r AS (SELECT session_id, id, CASE WHEN text = '' THEN 0 ELSE greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) END AS cost,
  row_number() OVER (PARTITION BY session_id ORDER BY timestamp NULLS FIRST, id) AS n FROM {_U} WHERE text IS NOT NULL AND session_id IS NOT NULL),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS kept FROM (SELECT DISTINCT session_id FROM r)
  UNION ALL SELECT f.session_id, r.n, CASE WHEN used + cost <= 60 THEN used + cost ELSE used END, CASE WHEN used + cost <= 60 THEN list_append(kept, r.id) ELSE kept END FROM f JOIN r ON r.session_id = f.session_id AND r.n = f.n + 1)
SELECT session_id AS sample_id, arg_max(kept, n) AS kept FROM f GROUP BY session_id""")  # fmt: skip
def _greedy(s, d):
    u = _utterances(s, d).where("text is not null and session_id is not null")
    ranked = u.select(F.col("session_id").alias("sample_id"), F.struct("timestamp", "id").alias("rank"), F.col("id").alias("pos"), lexical.estimated_tokens(F.col("text")).alias("cost"))
    return evaluate.fill(ranked, 60)


# ---- routing and evaluation ----------------------------------------------------------------------
_OUT = "SELECT CASE CAST(user_id % 4 AS INTEGER) WHEN 0 THEN 'temporal' WHEN 1 THEN 'preference' WHEN 2 THEN 'factual' ELSE 'procedural' END AS query_type, event_type AS path, value > 20 AS success, CAST(floor(value) AS BIGINT) AS latency_ms, event_id % 500 AS tokens_used FROM events"
_RATES = f"SELECT query_type, path, count(*) AS attempts, count(*) FILTER (success) AS successes, round((count(*) FILTER (success) + 1) / (count(*) + 2), 4) AS success_rate FROM ({_OUT}) GROUP BY ALL"


def _outcomes(s, d) -> DataFrame:
    e = _t(s, d, "events")
    kind = F.get(F.array(*map(F.lit, ("temporal", "preference", "factual", "procedural"))), (F.col("user_id") % 4).cast("int"))
    return e.select("event_id", kind.alias("query_type"), F.col("event_type").alias("path"), (F.col("value") > 20).alias("success"), F.floor("value").cast("bigint").alias("latency_ms"), (F.col("event_id") % 500).alias("tokens_used"))


@query("bandit_rates", _RATES)
def _rates(s, d):
    return routing.rates(_outcomes(s, d)).select("query_type", "path", "attempts", "successes", "success_rate")


@query("bandit_costs", f"SELECT query_type, path, round_even(avg(latency_ms), 2) AS avg_latency_ms, round_even(avg(tokens_used), 2) AS avg_tokens FROM ({_OUT}) GROUP BY ALL")
def _costs(s, d):
    return routing.rates(_outcomes(s, d)).select("query_type", "path", "avg_latency_ms", "avg_tokens")


@query("routing_table", f"SELECT query_type, list(path ORDER BY success_rate DESC, path) AS paths FROM ({_RATES}) GROUP BY query_type")
def _table(s, d):
    return routing.routing_table(routing.rates(_outcomes(s, d))).select("query_type", F.transform("entries", lambda e: e["path"]).alias("paths"))


@query("best_paths", f"SELECT query_type, arg_min(path, (-success_rate, -attempts, path)) AS path FROM ({_RATES}) WHERE attempts >= 3 GROUP BY query_type")
def _best(s, d):
    o = _outcomes(s, d)
    q = o.select("query_type").distinct().withColumn("query_id", F.col("query_type"))
    return routing.best_path(q, routing.rates(o)).select("query_type", "path")


_RES = "SELECT predicate AS category, coalesce(confidence, 0) > 0.6 AS correct, polarity = 'negative' AS abstained, qualifier IS NULL AS should_abstain, CASE WHEN evidence IS NULL THEN NULL ELSE is_current END AS context_hit, length(coalesce(object, '')) AS context_tokens, length(coalesce(evidence, '')) AS latency_ms FROM " + _F


@query("eval_metrics", f"""SELECT category, n, accuracy, round(p, 6) AS abstain_precision, round(r, 6) AS abstain_recall, round(2 * p * r / nullif(p + r, 0), 6) AS abstain_f1, context_recall, mean_tokens, mean_latency, median_latency, max_latency FROM (
SELECT category, count(*) AS n, round(count(*) FILTER (correct) / count(*), 6) AS accuracy, count(*) FILTER (abstained AND should_abstain) / nullif(count(*) FILTER (abstained), 0) AS p, count(*) FILTER (abstained AND should_abstain) / nullif(count(*) FILTER (should_abstain), 0) AS r,
round(count(*) FILTER (context_hit) / nullif(count(context_hit), 0), 6) AS context_recall, round(avg(context_tokens), 6) AS mean_tokens, round(avg(latency_ms), 6) AS mean_latency, round(quantile_cont(latency_ms, 0.5), 6) AS median_latency, max(latency_ms) AS max_latency FROM ({_RES}) GROUP BY category)""")  # fmt: skip
def _metrics(s, d):
    f = _facts(s, d)
    r = f.select(F.col("predicate").alias("category"), (F.coalesce("confidence", F.lit(0.0)) > 0.6).alias("correct"), (F.col("polarity") == "negative").alias("abstained"), F.col("qualifier").isNull().alias("should_abstain"), F.when(F.col("evidence").isNotNull(), F.col("is_current")).alias("context_hit"), F.length(F.coalesce("object", F.lit(""))).alias("context_tokens"), F.length(F.coalesce("evidence", F.lit(""))).alias("latency_ms"))
    return evaluate.metrics(r, ["category"]).drop("recall_attempted")


@query("strata_quotas", f"""WITH g AS (SELECT predicate AS category, polarity = 'negative' AS abstain, count(*) AS n FROM {_F} GROUP BY ALL), x AS (SELECT *, n * 100 / sum(n) OVER () AS e FROM g), y AS (SELECT *, CAST(floor(e) AS BIGINT) AS b FROM x)
SELECT category, abstain, n, least(n, b + CASE WHEN row_number() OVER (ORDER BY e - b DESC, category, abstain) <= 100 - sum(b) OVER () THEN 1 ELSE 0 END) AS quota FROM y""")  # fmt: skip
def _quotas(s, d):
    return evaluate.strata_quotas(_facts(s, d).select(F.col("predicate").alias("category"), (F.col("polarity") == "negative").alias("abstain")), 100)


_PW = "list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', ' ', 'g')), '\\s+'), lambda x: length(x) >= 3)"


@query("turn_document_frequency", f"SELECT speaker AS sample_id, term, count(*) AS df FROM (SELECT id, speaker, unnest(list_distinct({_PW})) AS term FROM {_U}) GROUP BY ALL")
def _tdf(s, d):
    return evaluate.document_frequency(_utterances(s, d).select(F.col("speaker").alias("sample_id"), "text"))


@query("lexical_retriever", f"""WITH q AS (SELECT unnest(['nightly', 'import', 'slow', 'fact', 'table']) AS term), w AS (SELECT session_id, id, len({_PW}) AS n, unnest(list_distinct({_PW})) AS term FROM {_U} WHERE session_id IS NOT NULL),
t AS (SELECT session_id, count(*) AS total FROM {_U} WHERE session_id IS NOT NULL GROUP BY 1), h AS (SELECT w.* FROM w JOIN q USING (term)), df AS (SELECT session_id, term, count(*) AS df FROM h GROUP BY ALL)
SELECT session_id AS sample_id, id AS pos, round(sum(ln(total / (1 + df)) / sqrt(n)), 6) AS score FROM h JOIN df USING (session_id, term) JOIN t USING (session_id) GROUP BY ALL""")  # fmt: skip
def _retriever(s, d):
    u = _utterances(s, d).where("session_id is not null").select(F.col("session_id").alias("sample_id"), F.col("id").alias("pos"), "text")
    q = u.select("sample_id").distinct().withColumn("question", F.lit("nightly import slow fact table"))
    return evaluate.lexical_scores(u, q)


@query("session_tokens", "SELECT session_id, count(*) AS turns, sum(token_count) AS tokens FROM (SELECT DISTINCT * FROM turns) WHERE session_id IS NOT NULL GROUP BY session_id")
def _session_tokens(s, d):
    t = graph.node_table(s, d, "Turn").where("session_id is not null")
    return intake.token_totals(t, ["session_id"])


@query("session_summaries", "SELECT session_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(left(t, 159)) || '…' END AS summary FROM (SELECT session_id, arg_min(text, (turn_number, id)) AS t FROM (SELECT DISTINCT * FROM turns) WHERE session_id IS NOT NULL AND turn_number IS NOT NULL AND speaker = 'user' AND text IS NOT NULL GROUP BY 1)")
def _summaries(s, d):
    t = graph.node_table(s, d, "Turn").where("session_id is not null and turn_number is not null")
    return intake.summaries(t, ["session_id"], ["turn_number", "id"])


# ---- read models ---------------------------------------------------------------------------------
@query("newest_sessions", "SELECT id, user_id, strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started FROM (SELECT DISTINCT id, user_id, start_time FROM sessions) ORDER BY start_time DESC, id LIMIT 50")
def _newest(s, d):
    rows = _t(s, d, "sessions").select("id", "user_id", "start_time").distinct()
    return rows.orderBy(F.col("start_time").desc(), "id").limit(50).select("id", "user_id", to_iso(F.col("start_time")).alias("started"))


@query("conflicts_with_facts", f"{_MERGED}, c AS (SELECT id AS conflict_id, anchor_id FROM m WHERE outcome IN ('correction','update','contradiction')) SELECT conflict_id, list(f.object ORDER BY f.valid_from NULLS FIRST, f.id) AS objects FROM c JOIN {_F} f ON f.id IN (c.anchor_id, c.conflict_id) GROUP BY conflict_id")
def _conflict_model(s, d):
    sides = facts.conflicts(_merged(s, d)).select(F.col("new_id").alias("conflict_id"), F.explode(F.array("existing_id", "new_id")).alias("id"))
    j = sides.join(_facts(s, d).select("id", "object", "valid_from"), "id")
    return j.groupBy("conflict_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "id", "object"))), lambda x: x["object"]).alias("objects"))


# ---- streaming roll-ups (batch form; the stream gives the same) ----------------------------------
@query("windows_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _tumbling(s, d):
    return ingest.windowed(_t(s, d, "events"), "ts", "1 hour", None, ["event_type"]).withColumn("total", F.round("total", 4))


@query("windows_sliding", "SELECT w AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")
def _sliding(s, d):
    return ingest.windowed(_t(s, d, "events"), "ts", "2 hours", "1 hour").withColumn("total", F.round("total", 4))


@query("windows_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM h GROUP BY user_id, k""")  # fmt: skip
def _session_windows(s, d):
    return ingest.sessionised(_t(s, d, "events"), "user_id", "ts", "30 minutes")


# ---- extraction and answers (no SQL) -------------------------------------------------------------
@query("extracted_facts")
def _extracted(s, d):
    turns = graph.node_table(s, d, "Turn").select("id", "text", "speaker").distinct()
    return extract(turns, ["id"]).where("kind = 'fact'").select("id", "predicate", "object", "qualifier", "polarity", "cue", "seq")


@query("extracted_entities")
def _extracted_entities(s, d):
    return extract(_utterances(s, d).select("id", "text", "speaker"), ["id"]).where("kind = 'entity'").select("id", "canonical_name", "entity_type")


_QUESTIONS = ["Where do I live?", "What did usr-00000002 prefer before?", "Which nightly import was slow?", "How do I restart the fact table?", "What is my blood type?", "Who is allergic to sesame?"]


def memory(s: SparkSession, d: str) -> plan.Memory:
    """The stored tables; entities are the names typed, in canonical form, and the subjects of facts."""
    f = cut(_facts(s, d), "facts")
    found = cut(facts.conflicts(_merged(s, d)).select(F.col("new_id").alias("conflict_id"), "existing_id", "new_id"), "conflicts")
    edges = cut(facts.resolve_pairs(found, f).select(F.col("winner_id").alias("start_id"), F.col("loser_id").alias("end_id")).distinct(), "supersedes")
    known = graph.node_table(s, d, "Entity").select(lexical.canonical_name(F.col("name")).alias("canonical_name")).unionByName(f.select(F.col("subject").alias("canonical_name"))).where("canonical_name <> ''").distinct()
    sides = found.select("conflict_id", F.explode(F.array("existing_id", "new_id")).alias("fact_id"), F.lit("resolved").alias("status"))
    return plan.Memory(f, _utterances(s, d), graph.node_table(s, d, "Session"), edges, sides, cut(known, "known"))


@query("answers")
def _answers(s, d):
    q = s.createDataFrame([(f"q{i}", t) for i, t in enumerate(_QUESTIONS)], "query_id string, question string")
    return plan.answer(q, memory(s, d)).select("query_id", "question", "query_type", "path", "abstained", "score", "answer", "context_tokens")


@query("answers_batch")
def _answers_batch(s, d):
    """A question for every entry of the reference list, answered by one job."""
    q = _t(s, d, "canon_items").select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("Who knows "), F.col("canonical_name"), F.lit("?")).alias("question"))
    return plan.answer(q, memory(s, d)).select("query_id", "path", "abstained", "score", "answer", "context_tokens")


@query("intake_counters")
def _intake(s, d):
    """What every session of the tables adds to an empty memory."""
    sessions = _t(s, d, "sessions").select("id", "user_id", "start_time", "session_number", "session_summary")
    turns = _t(s, d, "turns").select("session_id", "turn_number", "timestamp", "speaker", "text")
    return intake.intake(sessions, turns)[1].drop("tenant")


@query("fact_titles", f"SELECT id, coalesce(predicate, '') || ': ' || coalesce(object, '') AS title FROM {_F}")
def _titles(s, d):
    return graph.node_titles(_facts(s, d), "Fact")


@query("running_rates", f"SELECT event_id, round_even((coalesce(sum(CAST(success AS INTEGER)) OVER w, 0) + 1) / (count(*) OVER w + 2), 4) AS rate_before FROM ({_OUT.replace('SELECT CASE', 'SELECT event_id, CASE', 1)}) WINDOW w AS (PARTITION BY query_type, path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _running(s, d):
    return routing.running_rates(_outcomes(s, d), F.col("event_id")).select("event_id", "rate_before")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


