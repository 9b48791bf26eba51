"""Questions answered in batch: classify, route, gather evidence, score, abstain or compose.

All questions of a table are answered by one job: every stage is a DataFrame keyed
by ``query_id``. The scan sides (facts, utterances) are read once for all
questions, scored where they are read and cut to the best per question in parts,
so a name that a third of all facts has meets no single task.

Questions and memory may have a ``tenant``; those of two tenants never meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.operators import budget, graph, routing, search
from strata.operators import facts as fact_ops
from strata.operators.extraction import question_entities
from strata.operators.timestamps import human_date
from strata.session import cut

# ---- fixed values ------------------------------------------------------------------------------
ABSTAIN_BELOW, WIDEN_BELOW = 0.3, 1.0
FACTS_KEPT, OTHERS_KEPT = 12, 13
CONTEXT_FACTS, CONTEXT_SAID = 12, 15
PATH_CAP, PATHS_KEPT, TEXT_CAND, VECTOR_CAND, NEWEST = 40, 400, 60, 40, 200
VECTOR_WEIGHT = 0.5
PATH_TYPES = ["MENTIONS", "HAS_UTTERANCE", "HAS_TURN", "DERIVED_FROM"]
REFUSAL = "I don't know — that isn't in the stored conversation history."
# ------------------------------------------------------------------------------------------------


LAYERS = ("semantic", "episodic")


def _tenanted(df: DataFrame | None) -> DataFrame | None:
    return df if df is None or "tenant" in df.columns else df.withColumn("tenant", F.lit("default"))


@dataclass(frozen=True)
class Memory:
    """The tables a question is answered from, each with or without ``tenant``."""

    facts: DataFrame
    utterances: DataFrame
    sessions: DataFrame
    supersedes: DataFrame  # start_id (winner), end_id (loser)
    conflicts: DataFrame | None = None  # conflict_id, fact_id, status
    entities: DataFrame | None = None  # canonical_name, and id where there are edges
    edges: DataFrame | None = None  # start_id, type, end_id
    vectors: DataFrame | None = None  # id of a fact or utterance, embedding

    @staticmethod
    def of(state, vectors: DataFrame | None = None) -> Memory:
        """The memory of an :class:`strata.plans.intake.State`."""
        sides = state.conflicts.select(F.col("id").alias("conflict_id"), F.explode(F.array("existing_id", "new_id")).alias("fact_id"), "status")
        edges = state.edges
        return Memory(state.facts, state.utterances, state.sessions, edges.where("type = 'SUPERSEDES'").select("start_id", "end_id"), sides, state.entities, edges, vectors)


def analyse(questions: DataFrame, memory: Memory, rated: DataFrame | None = None, force_path: str | None = None, explore: bool = False) -> DataFrame:
    """(query_id, tenant, question, query_type, path, reason, history, tokens, weights, names, entity_ids, vector).

    ``names`` are those of the question that the memory has an entity for; without a table of entities the subjects
    of facts count as such.
    """
    if force_path is not None and force_path not in [p[0] for p in routing.PATHS]:
        raise ValueError(f"unknown path {force_path!r}")
    questions = _tenanted(questions)
    vector = F.col("vector") if "vector" in questions.columns else F.lit(None).cast("array<float>")
    q = questions.select("query_id", "tenant", "question", vector.alias("vector"), lexical.classify(F.col("question")).alias("c"), lexical.wants_history(F.col("question")).alias("history"), lexical.content_tokens(F.col("question")).alias("tokens"))
    q = q.select("query_id", "tenant", "question", "vector", "c.query_type", F.col("c.confidence").alias("type_confidence"), "history", "tokens")
    empty = q.sparkSession.createDataFrame([], "query_type string, path string, attempts bigint, success_rate double")
    q = routing.best_path(q, rated if rated is not None else empty, explore)
    if force_path is not None:
        q = q.withColumn("path", F.lit(force_path)).withColumn("reason", F.lit("forced"))
    weights = search.idf_weights(_tenanted(memory.utterances), q.select("tenant", F.explode("tokens").alias("token")), by=["tenant"])
    per = q.select("query_id", "tenant", F.explode(F.array_distinct("tokens")).alias("token")).join(weights, ["tenant", "token"]).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))
    asked = question_entities(questions).select("query_id", F.col("canonical_name").alias("n")).unionByName(q.select("query_id", F.explode("tokens").alias("n"))).distinct()
    known = _tenanted(memory.entities)
    if known is None:
        known = _tenanted(memory.facts).select("tenant", F.col("subject").alias("canonical_name"), F.col("subject").alias("id"))
    known = known.select("tenant", F.col("canonical_name").alias("n"), *(["id"] if "id" in known.columns else [F.lit(None).cast("string").alias("id")])).distinct()
    found = asked.join(q.select("query_id", "tenant"), "query_id").join(known, ["tenant", "n"])
    # a question has few words, so it has few names
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_set("n")).alias("names"), F.array_sort(F.collect_set("id")).alias("entity_ids"))
    q = q.withColumn("q_stems", lexical.stem_list(F.col("tokens")))
    q = q.join(per, "query_id", "left").join(found, "query_id", "left")
    none = F.array().cast("array<string>")
    return q.withColumn("names", F.coalesce("names", none)).withColumn("entity_ids", F.coalesce("entity_ids", none))


def _overlap(stems: str) -> Column:
    """Overlap of the question with a column of stems; without weights every token weighs 1."""
    return lexical.overlap(F.col("tokens"), F.col(stems), F.coalesce("weights", F.create_map().cast("map<string,double>")), F.col("q_stems"))


def _meaning(rows: DataFrame, q: DataFrame, memory: Memory) -> DataFrame:
    """Adds ``semantic``: grounding by the similarity of the stored vector, 0 without vectors."""
    if memory.vectors is None:
        return rows.withColumn("semantic", F.lit(0.0))
    j = rows.join(memory.vectors.select("id", "embedding"), "id", "left").join(q.select("query_id", F.col("vector").alias("qv_")), "query_id", "left")
    return j.withColumn("semantic", F.coalesce(search.grounding(search.cosine(F.col("embedding"), F.col("qv_"))), F.lit(0.0))).drop("embedding", "qv_")


def _fallback(rows: DataFrame, bare: DataFrame, order: list[Column]) -> DataFrame:
    """(query_id, id): of the tenant of every bare question the first NEWEST rows."""
    best = search.top_k(rows, ["tenant"], order, NEWEST)
    return bare.join(best.select("tenant", "id"), "tenant").select("query_id", "id")


def fact_evidence(q: DataFrame, memory: Memory) -> DataFrame:
    """Facts anchored by name (subject or object), else the 200 most confident current ones; scored, the best FACTS_KEPT
    of each question (six or four on an episodic path), with ``best``, the best wording of all that were scored."""
    f = _tenanted(memory.facts)
    kept = ["query_id", "path", "history", "tokens", "q_stems", "weights"]
    names = q.select("tenant", *kept, "names", F.explode("names").alias("n"))
    by_subject = names.join(f.withColumn("n", F.col("subject")), ["tenant", "n"])
    # what a subject has found already is not found again by its object
    by_object = names.join(f.withColumn("n", F.col("object")), ["tenant", "n"]).where(~F.coalesce(F.array_contains("names", F.col("subject")), F.lit(False)))
    anchored = by_subject.unionByName(by_object).drop("n", "names")
    if memory.entities is None:
        named = q.where(F.size("names") > 0).select("query_id")
    else:  # a name may have no fact
        named = names.select("query_id", "tenant", "n").join(f.select("tenant", F.explode(F.array("subject", "object")).alias("n")).distinct(), ["tenant", "n"], "left_semi").select("query_id").distinct()
    bare = q.join(named, "query_id", "left_anti")
    rest = _fallback(f.where("is_current"), bare.select("query_id", "tenant"), [F.col("confidence").desc_nulls_last(), F.col("id").asc()])
    j = anchored.unionByName(rest.join(f, "id").join(q.select(*kept), "query_id").select(anchored.columns))
    keep_old = (F.col("path").isin("hybrid-conflict", "episodic-depth-3")) | F.col("history")
    current = F.coalesce("is_current", F.lit(False))
    j = j.where(current | keep_old)
    text = lexical.rendered_fact(F.col("subject"), F.col("predicate"), F.col("object"), F.col("qualifier"), F.col("polarity") == "negative", ~current)
    fact = ["id", "subject", "predicate", "object", "polarity", "qualifier", "confidence"]
    # in steps: texts, their stems, overlaps; each is evaluated once
    j = j.select(*kept, *fact, current.alias("is_current"), "evidence", F.col("valid_from").alias("at"), F.get("source_sessions", F.lit(0)).alias("session_id"), text.alias("text"))
    j = j.select(
        *kept, *fact, "is_current", "at", "session_id", "text",
        lexical.stems(F.replace("predicate", F.lit("_"), F.lit(" "))).alias("s1"), lexical.stems(F.concat_ws(" ", "object", "qualifier")).alias("s2"),
        lexical.stems(F.col("evidence")).alias("s3"), lexical.stems(F.col("text")).alias("s4"),
    )
    j = _meaning(j, q, memory)
    state = F.when(F.col("history"), F.when(F.col("is_current"), 0.05).otherwise(0.3)).otherwise(F.when(F.col("is_current"), 0.25).otherwise(0.0))
    score = 0.45 * _overlap("s1") + 0.25 * _overlap("s2") + 0.15 * _overlap("s3") + VECTOR_WEIGHT * F.col("semantic") + state + 0.1 * F.coalesce("confidence", F.lit(0.0))
    cap = F.when(F.col("path") == "episodic-depth-3", 6).when(F.col("path") == "episodic-depth-2", 4).otherwise(FACTS_KEPT)
    scored = j.select("query_id", F.lit("fact").alias("kind"), "text", F.bround(score, 6).alias("score"), _overlap("s4").alias("lexical"), "semantic", *fact, "is_current", "at", "session_id", F.lit(None).cast("string").alias("speaker"), cap.alias("cap"))
    part = Window.partitionBy("query_id", "part_")
    scored = scored.withColumn("part_", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("best", F.max(F.greatest("lexical", "semantic")).over(part))
    order = [F.col("score").desc(), F.col("id").asc()]
    first = scored.withColumn("r", F.row_number().over(part.orderBy(*order))).where(F.col("r") <= FACTS_KEPT)
    whole = Window.partitionBy("query_id")
    ranked = first.withColumn("best", F.max("best").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(*order)))
    return ranked.where(F.col("r") <= F.col("cap")).drop("r", "cap", "part_")


def said_candidates(q: DataFrame, memory: Memory) -> DataFrame:
    """(query_id, id) of utterances: by paths from the question's entities, by BM25 over its first six words of three
    letters, by vector, else the newest 200."""
    u = _tenanted(memory.utterances)
    terms = F.slice(F.filter("tokens", lambda t: F.length(t) >= 3), 1, 6)
    found = search.bm25(u, q.select("tenant", "query_id", terms.alias("terms")), "id", "text", TEXT_CAND * F.col("terms_"), ["tenant"]).select("query_id", "id")
    if memory.edges is not None:
        sources = q.select("query_id", F.when(F.col("path") == "episodic-depth-3", 3).otherwise(2).alias("depth_"), F.explode("entity_ids").alias("source_id"))
        e = memory.edges.select("start_id", "type", "end_id")
        walked = cut(graph.paths(e, sources.select(F.col("source_id").alias("id")), PATH_TYPES, "both", 3, PATH_CAP, None), "paths")
        mine = sources.join(walked, "source_id").where("depth <= depth_").select("query_id", "source_id", "depth", "nodes")
        mine = search.top_k(mine, ["query_id"], [F.col("source_id").asc(), F.col("depth").asc(), F.col("nodes").asc()], PATHS_KEPT)
        ids = mine.select("query_id", F.explode("nodes").alias("id")).distinct()
        found = found.unionByName(ids.join(u.select("id"), "id", "left_semi").select("query_id", "id"))
    if memory.vectors is not None:
        own = memory.vectors.join(u.select("id", "tenant"), "id")
        near = search.vector_top_k(own, q.where(F.col("vector").isNotNull()).select("query_id", "tenant", F.col("vector").alias("query")), "id", "embedding", VECTOR_CAND, ["tenant"])
        found = found.unionByName(near.select("query_id", "id"))
    found = cut(found.distinct(), "candidates")
    bare = q.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "tenant")
    return found.unionByName(_fallback(u, bare, [F.col("timestamp").desc_nulls_last(), F.col("id").asc()]))


def said_evidence(q: DataFrame, memory: Memory, limit: Column) -> DataFrame:
    """Candidates scored, at most ``limit`` each; such without any match only where there are few."""
    u = _tenanted(memory.utterances)
    j = said_candidates(q, memory).join(u.select("id", "text", "timestamp", "session_id", "speaker"), "id").join(q, "query_id")
    j = j.select("query_id", "id", "text", "timestamp", "session_id", "speaker", "tokens", "q_stems", "weights", limit.alias("lim"), lexical.stems(F.col("text")).alias("s1"))
    j = _meaning(j.select("query_id", "id", "text", "timestamp", "session_id", "speaker", "lim", _overlap("s1").alias("lexical")), q, memory)
    none = {c: F.lit(None).cast(t) for c, t in (("subject", "string"), ("predicate", "string"), ("object", "string"), ("polarity", "string"), ("qualifier", "string"), ("confidence", "double"), ("is_current", "boolean"))}
    worth = F.col("lexical") + VECTOR_WEIGHT * F.col("semantic")
    s = j.select("query_id", F.lit("utterance").alias("kind"), "text", F.bround(worth + 0.05, 6).alias("score"), "lexical", "semantic", "id", *[c.alias(n) for n, c in none.items()], F.col("timestamp").alias("at"), "session_id", "speaker", "lim", F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("n"))
    s = s.where((worth > 0) | (F.col("n") <= F.col("lim")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("at").desc_nulls_last(), "id")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("lim")).drop("r", "lim", "n")


def gather(q: DataFrame, memory: Memory, layers: set[str] | None = None) -> DataFrame:
    """Evidence by plan, widened to the texts where facts alone don't cover the question, capped by kind. ``layers``
    restricts what may be read (semantic, episodic); a layer left out is neither planned nor widened to."""
    if unknown := set(layers or ()) - set(LAYERS):
        raise ValueError(f"unknown layers {sorted(unknown)}")
    open_to = lambda layer: layers is None or layer in layers
    # an episodic path reads facts only to round off a question about what was
    wanted = q.where(~F.col("path").startswith("episodic") | F.col("history") | F.lit(layers is None))
    facts = cut(fact_evidence(wanted if open_to("semantic") else q.limit(0), memory), "fact-evidence")
    best = facts.groupBy("query_id").agg(F.max("best").alias("best"))
    facts = facts.drop("best")
    plan = q.join(best, "query_id", "left")
    episodic = F.col("path").startswith("episodic")
    widened = (F.col("path") == "semantic-only") & (F.coalesce("best", F.lit(0.0)) < WIDEN_BELOW)
    limit = F.when(F.col("path") == "episodic-depth-3", 20).when(F.col("path") == "episodic-depth-2", 15).otherwise(12)
    forced = F.lit(layers is not None and "semantic" not in layers)
    said = said_evidence(plan.where(episodic | widened | forced).drop("best") if open_to("episodic") else q.limit(0), memory, limit)
    both = facts.unionByName(said)
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.col("score").desc(), F.col("at").desc_nulls_last(), "id")))
    return ranked.where(F.col("r") <= F.when(F.col("kind") == "fact", FACTS_KEPT).otherwise(OTHERS_KEPT)).drop("r")


def public(kept: DataFrame, sessions: DataFrame, supersedes: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Evidence rows for the outside: numbers to four places, the session's label, what matched (wording, meaning,
    both, graph, none) and, for facts, what they replaced and were replaced by."""
    s = sessions.select(F.col("id").alias("session_id"), session_label().alias("session_label")).dropDuplicates(["session_id"])
    by = F.when((F.col("semantic") > 0) & (F.col("lexical") > 0), "both").when(F.col("semantic") > 0, "meaning").when(F.col("lexical") > 0, "wording")
    linked = F.col("graph_linked") if "graph_linked" in kept.columns else F.lit(False)
    rows = kept.withColumn("matched_by", by.when(linked, "graph").otherwise("none")).join(s, "session_id", "left")
    if supersedes is not None and facts is not None:
        rows = rows.join(fact_ops.supersession(facts, supersedes.withColumn("type", F.lit("SUPERSEDES"))), "id", "left")
    four = lambda c: F.bround(c, 4).alias(c)
    more = [c for c in ("supersedes", "superseded_by") if c in rows.columns]
    return rows.select("query_id", "kind", "id", "text", four("score"), four("lexical"), four("semantic"), "matched_by", "session_id", "session_label", F.col("at").alias("timestamp"), "predicate", "object", "qualifier", "polarity", "is_current", four("confidence"), "speaker", *more)


def session_label() -> Column:
    """``session N (date)`` of session rows."""
    number = F.concat(F.lit("session "), F.col("session_number").cast("string"), F.lit(" ("), human_date(F.col("start_time")), F.lit(")"))
    return F.when(F.col("session_number").isNotNull(), number).otherwise(F.concat(F.lit("session "), human_date(F.col("start_time"))))


def decide(q: DataFrame, evidence: DataFrame, memory: Memory) -> DataFrame:
    """(query_id, score, abstained, confidence, n, best, uncovered, open_conflicts, reasons) of each question."""
    head = evidence.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    e = head.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest("lexical", "semantic")).alias("best"), F.bool_or(F.coalesce("is_current", F.lit(False))).alias("current"), F.bool_or(F.col("kind") == "fact").alias("any_fact"),
        F.array_join(F.collect_list(F.when(F.col("r") <= 3, F.col("text"))), " ").alias("head"),
    )
    if memory.conflicts is not None:
        opened = evidence.where("kind = 'fact'").join(memory.conflicts.where("status = 'open'").drop("tenant"), F.col("id") == F.col("fact_id")).groupBy("query_id").agg(F.countDistinct("conflict_id").alias("open_conflicts"))
    else:
        opened = q.select("query_id", F.lit(0).cast("bigint").alias("open_conflicts")).limit(0)
    j = q.join(e, "query_id", "left").join(opened, "query_id", "left")
    j = j.withColumn("stems", lexical.stems(F.col("head")))
    n, best, stems = F.coalesce("n", F.lit(0)), F.coalesce("best", F.lit(0.0)), F.col("stems")
    mass = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, w: a + w)
    # what the three best texts leave open, the weightiest words first
    left = F.filter(F.map_entries("weights"), lambda x: ~F.coalesce(F.array_contains(stems, lexical.stem(x["key"])), F.lit(False)))
    j = j.withColumn("left_", F.array_sort(F.transform(left, lambda x: F.struct((-x["value"]).alias("w"), x["key"].alias("t")))))
    unseen = F.aggregate("left_", F.lit(0.0), lambda a, x: a - x["w"])
    uncovered = F.coalesce(F.when((n > 0) & F.col("weights").isNotNull(), F.try_divide(unseen, mass)), F.lit(0.0))
    opened_n = F.coalesce("open_conflicts", F.lit(0))
    known = F.size("names") > 0
    score = (
        F.when(known, 0.10).otherwise(-0.25)
        + F.when(n == 0, -0.45).when(n < 3, 0.05).otherwise(0.10)
        + (-0.45 + 0.9 * F.least(F.lit(1.0), best / 0.45))
        - 0.9 * uncovered
        + F.when(F.coalesce("current", F.lit(False)), 0.05).when(F.coalesce("any_fact", F.lit(False)), -0.10).otherwise(0.0)
        - F.when(opened_n > 0, 0.15).otherwise(0.0)
    )
    missing = F.array_join(F.transform(F.slice("left_", 1, 3), lambda x: x["t"]), ", ")
    reasons = F.filter(
        F.array(
            F.when(~known, "no entity of the question is known"), F.when(n == 0, "no evidence"), F.when(best < 0.45, "evidence hardly matches the question"),
            F.when(uncovered >= 0.25, F.concat(F.lit("not covered: "), missing)), F.when(~F.coalesce("current", F.lit(False)) & F.coalesce("any_fact", F.lit(False)), "no current fact"), F.when(opened_n > 0, "open conflicts"),
        ),
        lambda r: r.isNotNull(),
    )
    no = score < ABSTAIN_BELOW
    return j.select(
        "query_id", F.bround(score, 4).alias("score"), no.alias("abstained"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + 0.5)), 4).alias("confidence"), n.alias("n"), F.bround(best, 4).alias("best"),
        F.bround(uncovered, 4).alias("uncovered"), opened_n.alias("open_conflicts"), F.when(no, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def prune(evidence: DataFrame) -> DataFrame:
    """Evidence that matched or whose slot did; the three best where nothing did."""
    linked = fact_ops.slot_linked(evidence)
    hit = linked.select("query_id").distinct()
    rest = evidence.join(hit, "query_id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where("r <= 3").drop("r")
    return linked.unionByName(rest.withColumn("graph_linked", F.lit(False)))


def context(evidence: DataFrame, sessions: DataFrame, max_tokens: int = 4000, excerpt: int = 600) -> DataFrame:
    """(query_id, context, context_tokens): facts, then excerpts with their session, each section a prefix
    that stops at the first line beyond the budget."""
    s = sessions.select(F.col("id").alias("session_id"), session_label().alias("label_")).dropDuplicates(["session_id"])
    e = evidence.join(s, "session_id", "left")
    label = F.coalesce("label_", F.lit("session unknown date"))
    line = F.when(F.col("kind") == "fact", F.concat(F.lit("- "), F.col("text"))).otherwise(F.concat(F.lit("- ["), label, F.lit("] "), lexical.truncate(F.col("text"), excerpt)))
    e = e.select("query_id", "kind", "id", "score", line.alias("line")).withColumn("cost", lexical.estimated_tokens(F.col("line")))
    order = [F.col("score").desc(), F.col("id").asc()]
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(*order))).where(F.col("r") <= F.when(F.col("kind") == "fact", CONTEXT_FACTS).otherwise(CONTEXT_SAID))
    facts = budget.prefix(ranked.where("kind = 'fact'"), ["query_id"], order, "cost", max_tokens)
    spent = facts.groupBy("query_id").agg(F.max("used").alias("spent"))
    said = ranked.where("kind <> 'fact'").join(spent, "query_id", "left")
    said = budget.prefix(said, ["query_id"], order, "cost", max_tokens, F.coalesce("spent", F.lit(0))).drop("spent")
    lines = facts.unionByName(said)
    body = F.transform(F.array_sort(F.collect_list(F.struct((F.col("kind") != "fact").alias("k"), (-F.col("score")).alias("s"), "id", "line"))), lambda x: x["line"])
    return lines.groupBy("query_id").agg(F.array_join(body, "\n").alias("context"), F.max("used").cast("int").alias("context_tokens"))


def compose(q: DataFrame, kept: DataFrame, decisions: DataFrame, memory: Memory) -> DataFrame:
    """(query_id, answer, citations): the refusal, what held before, the best excerpt or the current fact with its siblings.

    What held before: of the facts that the question names, the best current one with what it replaced; where nothing
    was replaced, since a predicate may hold several values, the latest earlier fact of the same predicate that the
    question doesn't name.
    """
    order = F.struct((-F.col("score")).alias("s"), "id", "text", "subject", "predicate", "object", "polarity", "kind", "session_id", "is_current")
    top = kept.groupBy("query_id").agg(F.min(F.when(F.col("kind") == "fact", order)).alias("fact"), F.min(F.when(F.col("kind") != "fact", order)).alias("said"), F.slice(F.array_sort(F.collect_set("session_id")), 1, 3).alias("citations"))
    base = lambda c: lexical.base_and_category(F.col(c))["base"]
    facts = kept.where("kind = 'fact'")
    chosen = top.select("query_id", F.col("fact.id").alias("chosen_"), F.col("fact.predicate").alias("p_"), F.col("fact.polarity").alias("o_"), F.col("fact.subject").alias("s_"))
    same = facts.where("is_current").join(chosen, "query_id").where(F.col("subject").eqNullSafe(F.col("s_")) & F.col("polarity").eqNullSafe(F.col("o_")))
    same = same.where(F.when(lexical.is_functional(F.col("p_")), F.col("predicate") == F.col("p_")).otherwise(base("predicate") == base("p_")))
    same = same.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("chosen_")).alias("f"), (-F.col("score")).alias("s"), "id", "object"))).alias("o"))
    same = same.select("query_id", lexical.joined(F.transform(F.slice("o", 1, 5), lambda x: x["object"])).alias("objects"))
    prior = fact_ops.supersession(memory.facts, memory.supersedes.withColumn("type", F.lit("SUPERSEDES"))).select("id", "supersedes")
    pivots = facts.join(q.where("history").select("query_id", "q_stems"), "query_id").join(prior, "id", "left").withColumn("named_", F.arrays_overlap("q_stems", lexical.stems(F.col("object"))))
    by_edge = pivots.where(F.col("named_") & F.col("is_current") & (F.size("supersedes") > 0)).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "subject", "predicate", "object", F.array_join("supersedes", "\u001f").alias("was"))).alias("edge"))
    old = pivots.where(~F.coalesce("named_", F.lit(False)) & F.col("at").isNotNull()).select("query_id", "predicate", F.col("at").alias("then"), F.col("object").alias("was"))
    earlier = pivots.where(F.col("named_") & F.col("at").isNotNull()).join(old, ["query_id", "predicate"]).where("then < at")
    earlier = earlier.groupBy("query_id", "id").agg(F.min((-F.col("score"))).alias("s"), F.first("subject").alias("subject"), F.first("predicate").alias("predicate"), F.first("object").alias("object"), F.max_by("was", F.struct("then", "was")).alias("was"))
    earlier = earlier.groupBy("query_id").agg(F.min(F.struct("s", "id", "subject", "predicate", "object", "was")).alias("time"))
    j = q.join(decisions, "query_id").join(top, "query_id", "left").join(same, "query_id", "left").join(by_edge, "query_id", "left").join(earlier, "query_id", "left")
    # a question that names no value asks for what the best fact replaced
    replaced = pivots.where(F.col("is_current") & (F.size("supersedes") > 0)).groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "subject", "predicate", "object", F.array_join("supersedes", "\u001f").alias("was"))).alias("any_edge"))
    j = j.join(replaced, "query_id", "left")
    pivot = F.coalesce("edge", "time", "any_edge")
    was = lexical.rendered_fact(pivot["subject"], pivot["predicate"], lexical.joined(F.split(pivot["was"], "\u001f")), past=F.lit(True))
    by_said = F.col("said").isNotNull() & (F.col("fact").isNull() | (F.col("path").startswith("episodic") & ~F.col("history")))
    stated = lexical.rendered_fact(F.col("fact.subject"), F.col("fact.predicate"), F.coalesce("objects", F.col("fact.object")), negated=F.col("fact.polarity") == "negative")
    text = (
        F.when(F.col("abstained"), REFUSAL)
        .when(F.col("history") & pivot.isNotNull(), F.concat(F.upper(F.substring(was, 1, 1)), F.substring(was, F.lit(2), F.length(was)), F.lit(". That later changed to "), pivot["object"], F.lit(".")))
        .when(by_said, F.concat(F.lit('You said: "'), lexical.truncate(F.col("said.text"), 300), F.lit('"')))
        .when(F.col("fact").isNotNull(), F.concat(stated, F.lit(".")))
        .otherwise(REFUSAL)
    )
    return j.select("query_id", text.alias("answer"), F.when(F.col("abstained"), F.array().cast("array<string>")).otherwise(F.coalesce("citations", F.array().cast("array<string>"))).alias("citations"))


def answer(
    questions: DataFrame, memory: Memory, rated: DataFrame | None = None, max_tokens: int = 4000, force_path: str | None = None, explore: bool = False, restrict_layers: set[str] | None = None
) -> DataFrame:
    """One row per question (query_id, question, and what there is of tenant, vector): type, path, decision with its
    reasons, context, answer, citations and evidence."""
    q = cut(analyse(questions, memory, rated, force_path, explore), "questions")
    evidence = cut(gather(q, memory, restrict_layers), "evidence")
    decisions = cut(decide(q, evidence, memory), "decisions")
    kept = cut(prune(evidence), "kept")
    text = compose(q, kept, decisions, memory)
    told = context(kept, memory.sessions, max_tokens)
    j = q.select("query_id", "tenant", "question", "query_type", "type_confidence", "path", "reason").join(decisions, "query_id").join(text, "query_id").join(told, "query_id", "left")
    return j.withColumn("context_tokens", F.when(F.col("abstained"), 0).otherwise(F.coalesce("context_tokens", F.lit(0)))).withColumn("context", F.when(F.col("abstained"), "").otherwise(F.coalesce("context", F.lit(""))))


def outcomes(answers: DataFrame, success: DataFrame, at: Column, latency_ms: Column | None = None) -> DataFrame:
    """Outcome rows of answers, to be appended to the log the routing learns from; success: query_id, success."""
    j = answers.join(success.select("query_id", "success"), "query_id")
    latency = latency_ms if latency_ms is not None else F.lit(0).cast("bigint")
    return j.select(F.col("query_id"), F.col("path"), "query_type", "success", "abstained", latency.alias("latency_ms"), F.col("context_tokens").cast("bigint").alias("tokens_used"), at.alias("timestamp"))
