"""Sessions become memory in one step: turns, utterances, entities, facts, conflicts and the edges between them.

``intake`` maps a batch of sessions and a prior :class:`State` to the next state.
Everything but the merge of facts is computed per turn; the merge is one
aggregate by slot (``facts.merge_statements``), so a batch needs no order but the
one its rows carry (start of the session, session, turn, place in the turn). Ids
are hashes of what they name, so a batch that is run again gives the same rows.

A tenant is a column: entities and slots of two tenants never meet, and many
memories are built by one job.

Defined cases: sessions already known, or repeated in the batch, change nothing;
turns of unknown sessions are left out; null and blank texts have no utterances;
null speakers are users; a null session start counts as 1970.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.operators import facts as fact_ops
from strata.operators import graph
from strata.operators.extraction import extract
from strata.session import cut

# fixed values: confidence of a statement by the rules, of one by a model, and the longest evidence kept
RULE_CONFIDENCE, MODEL_CONFIDENCE, EVIDENCE = 0.7, 0.75, 400

SCHEMAS = {
    "sessions": "tenant string, id string, user_id string, start_time timestamp, end_time timestamp, session_number int, session_summary string, total_turns bigint, total_tokens bigint",
    "turns": "tenant string, id string, session_id string, turn_number int, timestamp timestamp, speaker string, text string, token_count int",
    "utterances": "tenant string, id string, text string, timestamp timestamp, utterance_number int, token_count int, speaker string, session_id string, turn_id string",
    "entities": "tenant string, id string, name string, canonical_name string, entity_type string, first_seen timestamp, last_seen timestamp, mention_count bigint",
    "facts": "tenant string, id string, subject string, predicate string, base_predicate string, object string, confidence double, valid_from timestamp, valid_until timestamp, is_current boolean, extraction_method string, source_sessions array<string>, evidence string, qualifier string, polarity string, last_seen timestamp",
    "conflicts": "tenant string, id string, conflict_type string, detected_at timestamp, resolved_at timestamp, resolution_policy string, status string, entity_id string, subject string, predicate string, existing_id string, new_id string",
    "edges": "tenant string, start_id string, type string, end_id string",
}


@dataclass(frozen=True)
class State:
    """The tables of one version of the memory."""

    sessions: DataFrame
    turns: DataFrame
    utterances: DataFrame
    entities: DataFrame
    facts: DataFrame
    conflicts: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in SCHEMAS}


def hashed(prefix: str, *parts: Column | str) -> Column:
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\u001f", *cols), 256), 1, 20))


def summaries(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, summary): the first text of the user, shortened."""
    first = turns.where("speaker = 'user' and text is not null").groupBy(*by).agg(F.min_by("text", F.struct(*order)).alias("t"))
    return first.select(*by, lexical.truncate(F.col("t"), 160).alias("summary"))


def token_totals(turns: DataFrame, by: list[str]) -> DataFrame:
    """(by, turns, tokens) of distinct turns."""
    return turns.groupBy(*by).agg(F.count(F.lit(1)).alias("turns"), F.sum("token_count").alias("tokens"))


def entity_upserts(mentions: DataFrame, by: list[str], nulls_first: bool = False) -> DataFrame:
    """(by, mentions, first_seen, last_seen, entity_type, name) of entity rows: counted, with the first type and name
    there is, by first_seen and id, a null of which is the last (or the first); a row without a type counts too."""
    order = ["first_seen", "id"] if nulls_first else [F.isnull("first_seen"), "first_seen", F.isnull("id"), "id"]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, c))).getField(c).alias(c)
    return mentions.groupBy(*by).agg(F.count(F.lit(1)).alias("mentions"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), first("entity_type"), first("name"))


def mention_edges(said: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """(utterance_id, canonical_name): utterances (on, id, text) and the names of their turn (on, canonical_name) that
    occur in the text; ``user`` goes with every utterance. The names of a turn travel as one array, so no pairs are
    formed that don't hold."""
    own = names.groupBy(*on).agg(F.collect_set("canonical_name").alias("names_"))
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.filter("names_", lambda n: (n == "user") | F.contains(low, n))
    return said.join(own, on).select(F.col("id").alias("utterance_id"), F.explode(hits).alias("canonical_name")).distinct()


def evidence_utterances(stated: DataFrame, said: DataFrame, on: list[str]) -> DataFrame:
    """(fact_id, utterance_id): of the utterances of a turn (on, id, utterance_number, text) the first that holds the
    evidence of a fact (on, id, evidence) in any case, else the first.

    Evidence is a whole sentence as a rule: that is an equality join. Only what it leaves is searched for.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    u = said.select(*on, F.col("id").alias("utterance_id"), F.col("utterance_number").alias("n_"), plain(F.col("text")).alias("t_"))
    f = stated.select(*on, F.col("id").alias("fact_id"), plain(F.col("evidence")).alias("e_"))
    first = u.groupBy(*on).agg(F.min(F.struct("n_", "utterance_id")).alias("first_"))
    whole = u.groupBy(*on, "t_").agg(F.min(F.struct("n_", "utterance_id")).alias("whole_"))
    exact = f.where("e_ <> ''").join(whole.withColumnRenamed("t_", "e_"), [*on, "e_"]).select("fact_id", "whole_")
    rest = f.where("e_ <> ''").join(exact.select("fact_id"), "fact_id", "left_anti")
    part = rest.join(u, on).where(F.contains("t_", F.col("e_"))).groupBy("fact_id").agg(F.min(F.struct("n_", "utterance_id")).alias("part_"))
    # an earlier utterance may hold the sentence as a part of itself only if it is longer; the whole one is the evidence then
    j = f.join(exact, "fact_id", "left").join(part, "fact_id", "left").join(first, on)
    return j.select("fact_id", F.coalesce("whole_", "part_", "first_").getField("utterance_id").alias("utterance_id"))


def conflict_edges(conflicts: DataFrame) -> DataFrame:
    """INVOLVES (with the role) from a conflict (id, existing_id, new_id) to both facts, CONFLICTS_WITH from the old to the new."""
    edge = lambda start, kind, end, role: F.struct(F.col(start).alias("start_id"), F.lit(kind).alias("type"), F.col(end).alias("end_id"), F.lit(role).alias("role"))
    rows = F.array(edge("id", "INVOLVES", "existing_id", "existing"), edge("id", "INVOLVES", "new_id", "new"), edge("existing_id", "CONFLICTS_WITH", "new_id", ""))
    return conflicts.select(F.explode(rows).alias("e")).select("e.*")


def counters(merged: DataFrame, by: list[str]) -> DataFrame:
    """(by, facts_created, facts_reinforced, conflicts_detected) of merged statements."""
    is_ = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return merged.groupBy(*by).agg(
        F.count_if(F.col("outcome") != "reinforce").alias("facts_created"), is_("reinforce").alias("facts_reinforced"), is_("correction", "update", "contradiction").alias("conflicts_detected")
    )


def _edges(df: DataFrame, start: str, kind: str, end: str) -> DataFrame:
    return df.select("tenant", F.col(start).alias("start_id"), F.lit(kind).alias("type"), F.col(end).alias("end_id")).where("start_id is not null and end_id is not null")


def _with(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the columns of a schema; those it lacks are null."""
    kinds = [c.strip().split(" ", 1) for c in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def intake(sessions: DataFrame, turns: DataFrame, state: State | None = None, extractor: Callable[..., DataFrame] | None = None, method: str = "rule-based") -> tuple[State, DataFrame]:
    """(next state, counters per session).

    sessions: id, and of tenant, user_id, start_time, session_number, session_summary what there is; turns:
    session_id, turn_number, and of tenant, timestamp, speaker, text what there is. ``extractor`` has the form of
    ``extraction.extract`` (a model's rows joined with the rules', for instance); the rules by default.
    """
    spark = sessions.sparkSession
    state = state or State.empty(spark)
    fill = lambda df: df if "tenant" in df.columns else df.withColumn("tenant", F.lit("default"))
    s = _with(fill(sessions), SCHEMAS["sessions"]).where("id is not null").dropDuplicates(["tenant", "id"]).join(state.sessions.select("tenant", "id"), ["tenant", "id"], "left_anti")
    s = s.withColumn("user_id", F.coalesce("user_id", F.lit("default"))).withColumn("session_number", F.coalesce("session_number", F.lit(0)))
    s = cut(s, "sessions")
    t = _with(fill(turns), SCHEMAS["turns"]).where("session_id is not null and turn_number is not null")
    t = t.join(s.select("tenant", F.col("id").alias("session_id"), F.col("start_time").alias("start_")), ["tenant", "session_id"])
    t = t.select(
        "tenant", hashed("turn", "tenant", "session_id", "turn_number").alias("id"), "session_id", "turn_number", F.coalesce("timestamp", "start_").alias("timestamp"),
        F.lower(F.trim(F.coalesce("speaker", F.lit("user")))).alias("speaker"), "text", lexical.estimated_tokens(F.col("text")).alias("token_count"), "start_",
    )
    t = cut(t.dropDuplicates(["tenant", "id"]), "turns")
    u = t.select("tenant", "session_id", F.col("id").alias("turn_id"), "timestamp", "speaker", F.posexplode(lexical.sentences(F.col("text"))).alias("utterance_number", "text"))
    u = u.withColumn("id", hashed("utt", "turn_id", "utterance_number")).withColumn("token_count", lexical.estimated_tokens(F.col("text")))
    u = cut(_with(u, SCHEMAS["utterances"]), "utterances")

    found = (extractor or extract)(t.select("tenant", F.col("id").alias("turn_id"), "session_id", "timestamp", "start_", "turn_number", "text", "speaker"), ["tenant", "turn_id", "session_id", "timestamp", "start_", "turn_number"])
    found = cut(found, "extracted")
    named = found.where("kind = 'entity'").select("tenant", "turn_id", "canonical_name", "entity_type", F.col("evidence").alias("name"), F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"), F.concat_ws("/", "turn_id", F.lpad(F.col("seq").cast("string"), 20, "0")).alias("id"))
    named = named.unionByName(state.entities.select("tenant", F.lit(None).cast("string").alias("turn_id"), "canonical_name", "entity_type", "name", "first_seen", "last_seen", F.lit("").alias("id")))
    known = state.entities.select("tenant", "canonical_name", F.col("mention_count").alias("before"))
    # a null time is that of a session without a start, which counts as 1970
    e = entity_upserts(named, ["tenant", "canonical_name"], nulls_first=True).join(known, ["tenant", "canonical_name"], "left")
    # a known entity is one of the rows itself
    e = e.withColumn("mention_count", F.col("mentions") + F.coalesce(F.col("before") - 1, F.lit(0))).withColumn("id", hashed("ent", "tenant", "canonical_name"))
    e = cut(_with(e, SCHEMAS["entities"]), "entities")

    order = F.struct(F.coalesce("start_", fact_ops.epoch()).alias("start"), F.col("session_id"), F.col("turn_number"), F.col("seq").alias("place"))
    st = found.where("kind = 'fact'").select(
        "tenant", hashed("fact", "turn_id", "seq", "predicate", "object").alias("id"), F.lit("user").alias("subject"), "predicate", "object", "polarity", F.lit(RULE_CONFIDENCE if method == "rule-based" else MODEL_CONFIDENCE).alias("confidence"),
        order.alias("seq"), "cue", F.substring("evidence", 1, EVIDENCE).alias("evidence"), "qualifier", "turn_id", "session_id", F.col("start_").alias("valid_from"), "timestamp",
    )
    st = cut(st, "statements")
    current = state.facts.where("is_current").select("tenant", "id", "subject", "predicate", "object", "polarity", "valid_from")
    merged = cut(fact_ops.merge_statements(st, current, by=["tenant"]).join(st.select("id", "qualifier", "evidence", "turn_id", "session_id", "valid_from", "timestamp"), "id"), "merged")
    again = merged.where("outcome = 'reinforce'").groupBy(F.col("anchor_id").alias("id")).agg(F.count(F.lit(1)).alias("k_"), F.collect_set("session_id").alias("more_"), F.max("timestamp").alias("seen_"))
    fresh = _with(
        merged.where("outcome <> 'reinforce'")
        .withColumn("base_predicate", F.split_part("predicate", F.lit("@"), F.lit(1))).withColumn("is_current", F.col("outcome") == "current")
        .withColumn("extraction_method", F.lit(method)).withColumn("source_sessions", F.array("session_id")),
        SCHEMAS["facts"],
    )
    f = state.facts.unionByName(fresh).join(again, "id", "left")
    k = F.coalesce("k_", F.lit(0))
    f = f.withColumn("confidence", F.when(k > 0, F.least(F.lit(1.0), F.bround(F.col("confidence") + k * 0.1, 4))).otherwise(F.col("confidence")))
    f = f.withColumn("source_sessions", F.when(k > 0, F.array_union("source_sessions", F.array_sort("more_"))).otherwise(F.col("source_sessions"))).withColumn("last_seen", F.coalesce("seen_", "last_seen"))
    f = cut(_with(f, SCHEMAS["facts"]), "facts")

    c = merged.where("outcome in ('correction', 'update', 'contradiction')").select(
        "tenant", hashed("conf", "anchor_id", "id").alias("id"), F.col("outcome").alias("conflict_type"), F.col("timestamp").alias("detected_at"), F.lit("pending").alias("resolution_policy"), F.lit("open").alias("status"),
        hashed("ent", "tenant", "subject").alias("entity_id"), "subject", "predicate", F.col("anchor_id").alias("existing_id"), F.col("id").alias("new_id"),
    )
    c = cut(_with(c, SCHEMAS["conflicts"]), "conflicts")

    turn_names = named.where("turn_id is not null").select("turn_id", "canonical_name")
    said = u.select("turn_id", "id", "text", "utterance_number", "tenant")
    tenants = u.select(F.col("id").alias("utterance_id"), "tenant")
    mentions = mention_edges(said, turn_names, ["turn_id"]).join(tenants, "utterance_id").withColumn("entity_id", hashed("ent", "tenant", "canonical_name"))
    proof = evidence_utterances(merged.where("outcome <> 'reinforce'").select("turn_id", "id", "evidence"), said, ["turn_id"]).join(fresh.select(F.col("id").alias("fact_id"), "tenant"), "fact_id")
    chain = graph.turn_chain(t.withColumn("session_id", F.concat_ws("\u001f", "tenant", "session_id"))).where("next_id is not null").select(F.split_part("session_id", F.lit("\u001f"), F.lit(1)).alias("tenant"), "id", "next_id")
    all_sessions = state.sessions.unionByName(_with(s, SCHEMAS["sessions"]))
    days = graph.session_chain(all_sessions.select(F.concat_ws("\u001f", "tenant", "user_id").alias("user_id"), "id", "start_time")).where("previous_id is not null").select(F.split_part("user_id", F.lit("\u001f"), F.lit(1)).alias("tenant"), "id", "previous_id")
    new = [
        _edges(t, "session_id", "HAS_TURN", "id"), _edges(u, "turn_id", "HAS_UTTERANCE", "id"), _edges(chain, "id", "NEXT", "next_id"), _edges(chain, "next_id", "PREVIOUS", "id"),
        _edges(days, "previous_id", "NEXT", "id"), _edges(days, "id", "PREVIOUS", "previous_id"), _edges(mentions, "utterance_id", "MENTIONS", "entity_id"),
        _edges(fresh.withColumn("entity_id", hashed("ent", "tenant", "subject")), "entity_id", "HAS_FACT", "id"), _edges(proof, "fact_id", "DERIVED_FROM", "utterance_id"),
        _edges(merged.where("outcome <> 'reinforce'"), "id", "DERIVED_FROM", "session_id"),
    ]
    more = c.select("tenant", "id", "existing_id", "new_id")
    new += [_edges(more, "id", "INVOLVES", "existing_id"), _edges(more, "id", "INVOLVES", "new_id"), _edges(more, "existing_id", "CONFLICTS_WITH", "new_id")]
    edges = state.edges
    for part in new:
        edges = edges.unionByName(part)
    edges = cut(edges.distinct(), "edges")

    totals = token_totals(t, ["tenant", "session_id"]).withColumnRenamed("session_id", "id")
    told = summaries(t, ["tenant", "session_id"], ["turn_number", "id"]).withColumnRenamed("session_id", "id")
    ends = t.groupBy("tenant", F.col("session_id").alias("id")).agg(F.max_by("timestamp", "turn_number").alias("last_"))
    s = s.drop("total_turns", "total_tokens").join(totals, ["tenant", "id"], "left").join(told, ["tenant", "id"], "left").join(ends, ["tenant", "id"], "left")
    s = s.select("*", F.coalesce("turns", F.lit(0)).alias("total_turns"), F.coalesce("tokens", F.lit(0)).alias("total_tokens"))
    s = s.withColumn("session_summary", F.coalesce(F.nullif("session_summary", F.lit("")), "summary")).withColumn("end_time", F.coalesce("last_", "end_time"))
    report = s.select("tenant", F.col("id").alias("session_id"), F.col("total_turns").alias("turns"))
    report = report.join(u.groupBy("tenant", "session_id").agg(F.count(F.lit(1)).alias("utterances")), ["tenant", "session_id"], "left")
    first_named = named.where("turn_id is not null").join(state.entities.select("tenant", "canonical_name"), ["tenant", "canonical_name"], "left_anti")
    first_named = first_named.groupBy("tenant", "canonical_name").agg(F.min(F.struct("first_seen", "id", "turn_id")).getField("turn_id").alias("turn_id")).join(t.select(F.col("id").alias("turn_id"), "session_id"), "turn_id")
    report = report.join(first_named.groupBy("tenant", "session_id").agg(F.count(F.lit(1)).alias("entities_extracted")), ["tenant", "session_id"], "left")
    report = report.join(counters(merged, ["tenant", "session_id"]), ["tenant", "session_id"], "left").fillna(0)
    out = State(
        sessions=cut(state.sessions.unionByName(_with(s, SCHEMAS["sessions"])), "state"), turns=state.turns.unionByName(_with(t, SCHEMAS["turns"])), utterances=state.utterances.unionByName(u), entities=e, facts=f,
        conflicts=state.conflicts.unionByName(c), edges=edges,
    )
    return out, report


def sleep(state: State, policy: str = "recency", now: Column | None = None, limit: int = 50) -> tuple[State, DataFrame]:
    """(state, report) after a consolidation: of each tenant the oldest ``limit`` open conflicts are resolved, then
    current facts that state the same are merged into the earliest. report: tenant, policy, conflicts_examined,
    conflicts_resolved, facts_superseded, duplicates_merged."""
    from strata.operators import search

    at = now if now is not None else F.current_timestamp()
    opened = search.top_k(state.conflicts.where("status = 'open'"), ["tenant"], [F.col("detected_at").asc(), F.col("id").asc()], limit)
    opened = cut(opened, "opened")
    pairs = opened.select(F.col("id").alias("conflict_id"), "existing_id", "new_id", F.struct("detected_at", "id").alias("seq"))
    facts, supersedes = fact_ops.consolidate(state.facts, pairs, policy, at)
    facts = cut(facts, "facts")
    done = fact_ops.resolve_pairs(pairs, state.facts, policy).select(F.col("conflict_id").alias("id"), "winner_id", "loser_id")
    done = cut(done, "resolved")
    merged, twice = fact_ops.close_duplicates(facts, at, by=["tenant"])
    merged, twice = cut(merged, "facts"), cut(twice, "duplicates")
    closed = state.conflicts.join(opened.select("id", F.lit(True).alias("seen_")), "id", "left")
    conflicts = closed.withColumn("status", F.when(F.col("seen_"), "resolved").otherwise(F.col("status"))).withColumn("resolved_at", F.when(F.col("seen_"), at).otherwise(F.col("resolved_at")))
    conflicts = _with(conflicts.withColumn("resolution_policy", F.when(F.col("seen_"), policy).otherwise(F.col("resolution_policy"))), SCHEMAS["conflicts"])
    whose = state.facts.select(F.col("id").alias("start_id"), "tenant")
    more = supersedes.unionByName(twice.select(F.col("keep_id").alias("start_id"), F.lit("SUPERSEDES").alias("type"), F.col("id").alias("end_id"))).join(whose, "start_id")
    won = done.select(F.col("id").alias("start_id"), F.lit("RESOLVED_TO").alias("type"), F.col("winner_id").alias("end_id")).join(opened.select(F.col("id").alias("start_id"), "tenant"), "start_id")
    edges = cut(state.edges.unionByName(more.select(*state.edges.columns)).unionByName(won.select(*state.edges.columns)).distinct(), "edges")
    report = opened.groupBy("tenant").agg(F.count(F.lit(1)).alias("conflicts_examined"))
    sides = done.join(opened.select("id", "tenant"), "id").groupBy("tenant").agg(F.count(F.lit(1)).alias("conflicts_resolved"), F.countDistinct("loser_id").alias("facts_superseded"))
    dup = twice.join(whose.withColumnRenamed("start_id", "id"), "id").groupBy("tenant").agg(F.count(F.lit(1)).alias("duplicates_merged"))
    report = report.join(sides, "tenant", "full").join(dup, "tenant", "full").fillna(0).withColumn("policy", F.lit(policy))
    return replace(state, facts=merged, conflicts=conflicts, edges=edges), report
