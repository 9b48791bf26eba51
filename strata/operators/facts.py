"""The fact log: merge of statements, conflicts, resolution policies, duplicate merge and read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import lexical

POLICIES = ("recency", "frequency", "confidence", "trust")


def epoch() -> Column:
    return F.lit("1970-01-01T00:00:00Z").cast("timestamp")


def distinct_facts(facts: DataFrame) -> DataFrame:
    return facts.dropDuplicates(["id"])


def merge_statements(statements: DataFrame, priors: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Each statement with what becomes of it, in closed form and without a fold.

    statements: id, subject, predicate, object, polarity, confidence, seq (order of
    arrival), cue. Between two consolidations a functional slot has one anchor (its
    prior current fact, else its first statement) and a multi-valued one has an
    anchor per object. A statement is then

    - ``current`` if it is the anchor,
    - ``reinforce`` if object and polarity are the anchor's,
    - ``correction`` if only the polarity differs,
    - ``update`` / ``contradiction`` if a functional slot already holds another object.

    ``anchor_id`` names the fact it meets. Anchors come from an aggregate by slot
    (smallest arrival), so hot slots are combined map-side; the way back is a join
    whose hot keys the adaptive plan splits. ``by``: columns that keep slots apart (a
    tenant). Of several prior facts with a statement's object the newest is its anchor,
    its rival is the newest of all.
    """
    by = by or []
    s = statements.withColumn("functional", lexical.is_functional(F.col("predicate"))).withColumn("scope", F.when(F.col("functional"), F.lit("")).otherwise(F.col("object")))
    slot = [*by, "subject", "predicate", "scope"]
    fact = F.struct("id", "object", "polarity")
    anchors = s.groupBy(*slot).agg(F.min(F.struct("seq", "id", "object", "polarity")).alias("f")).select(*slot, F.struct("f.id", "f.object", "f.polarity").alias("a"))
    j = s.join(anchors, slot)
    if priors is not None:
        p = priors.withColumn("scope", F.when(lexical.is_functional(F.col("predicate")), F.lit("")).otherwise(F.col("object")))
        newest = p.groupBy(*slot).agg(F.max_by(fact, F.struct("valid_from", "id")).alias("h"))
        same = p.groupBy(*slot, "object").agg(F.max_by(fact, F.struct("valid_from", "id")).alias("o"))
        j = j.join(newest, slot, "left").join(same, [*slot, "object"], "left").withColumn("a", F.coalesce("o", "h", "a"))
    a = F.col("a")
    kind = (
        F.when(F.col("id") == a["id"], "current")
        .when((F.col("object") == a["object"]) & (F.col("polarity") == a["polarity"]), "reinforce")
        .when(F.col("object") == a["object"], "correction")
        .otherwise(F.when(F.col("cue") == "update", "update").when(F.col("cue") == "correction", "correction").otherwise("contradiction"))
    )
    return j.select(*by, "id", "subject", "predicate", "object", "polarity", "confidence", "seq", kind.alias("outcome"), a["id"].alias("anchor_id"))


def merged_facts(merged: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, polarity, confidence, is_current, times): the stored facts after a merge.
    Every reinforcement adds 0.1, up to 1."""
    times = merged.where("outcome = 'reinforce'").groupBy(F.col("anchor_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    kept = merged.where("outcome <> 'reinforce'").join(times, "id", "left")
    k = F.coalesce("k", F.lit(0))
    conf = F.least(F.lit(1.0), F.round(F.coalesce("confidence", F.lit(0.7)) + k * 0.1, 4))
    return kept.select("id", "subject", "predicate", "object", "polarity", conf.alias("confidence"), (F.col("outcome") == "current").alias("is_current"), (k + 1).cast("bigint").alias("times"))


def conflicts(merged: DataFrame) -> DataFrame:
    """(existing_id, new_id, subject, predicate, conflict_type) for statements that contradict what is held."""
    return merged.where("outcome in ('correction', 'update', 'contradiction')").select(F.col("anchor_id").alias("existing_id"), F.col("id").alias("new_id"), "subject", "predicate", F.col("outcome").alias("conflict_type"))


def policy_rank(policy: str) -> Column:
    """The largest value wins. Null dates count as 1970; ties go to the smaller id, by the caller."""
    at = F.coalesce(F.col("valid_from"), epoch())
    n = F.coalesce(F.size(F.array_distinct("source_sessions")), F.lit(0))
    n = F.greatest(n, F.lit(0))
    conf = F.coalesce("confidence", F.lit(0.0))
    ranks = {
        "recency": F.struct(at.alias("a")),
        "frequency": F.struct(n.alias("a"), at.alias("b")),
        "confidence": F.struct(conf.alias("a"), at.alias("b")),
        "trust": F.struct((F.coalesce("extraction_method", F.lit("")) != "llm-extract").alias("a"), n.alias("b"), at.alias("c")),
    }
    if policy not in ranks:
        raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")
    return ranks[policy]


def slot_winners(facts: DataFrame, policy: str = "recency") -> DataFrame:
    """(subject, predicate, winner_id, n): the winner among all facts of a functional slot (slot mode)."""
    f = facts.where(lexical.is_functional(F.col("predicate"))).withColumn("r", policy_rank(policy))
    best = f.groupBy("subject", "predicate").agg(F.max("r").alias("top"), F.count(F.lit(1)).alias("n"))
    # of equal ranks the smallest id: a second aggregate, since struct order can't mix directions on text
    tied = f.join(best, ["subject", "predicate"]).where(F.col("r") == F.col("top"))
    return tied.groupBy("subject", "predicate").agg(F.min("id").alias("winner_id"), F.first("n").alias("n"))


def resolve_pairs(pairs: DataFrame, facts: DataFrame, policy: str = "recency") -> DataFrame:
    """(conflict_id, winner_id, loser_id) of two-fact conflicts (conflict_id, existing_id, new_id), each on its own (pairwise mode)."""
    f = facts.select("id", policy_rank(policy).alias("r"))
    sides = pairs.select("conflict_id", F.explode(F.array("existing_id", "new_id")).alias("id")).join(f, "id")
    agg = sides.groupBy("conflict_id").agg(F.max("r").alias("top"), F.collect_list(F.struct("id", "r")).alias("two"))
    winner = F.array_min(F.transform(F.filter("two", lambda x: x["r"] == F.col("top")), lambda x: x["id"]))
    return agg.where(F.size("two") == 2).select("conflict_id", winner.alias("winner_id"), "two").select("conflict_id", "winner_id", F.get(F.filter(F.transform("two", lambda x: x["id"]), lambda i: i != F.col("winner_id")), F.lit(0)).alias("loser_id"))


def consolidate(facts: DataFrame, pairs: DataFrame, policy: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(facts, SUPERSEDES edges) after resolving ``pairs`` in their order.

    A winner becomes current with confidence min(.95, .8 + .05 n_sources), open
    ended and marked consolidated; a loser is closed at ``now``. A fact that both
    wins and loses ends as its last conflict (by ``seq``) says, so a loser may come
    back, as in a sequence of single resolutions; under the policies confidence and
    trust each conflict is judged by the facts as they were before the batch.
    """
    done = resolve_pairs(pairs, facts, policy).join(pairs.select("conflict_id", "seq"), "conflict_id")
    roles = done.select("seq", F.col("winner_id").alias("id"), F.lit(True).alias("won")).unionByName(done.select("seq", F.col("loser_id").alias("id"), F.lit(False).alias("won")))
    last = roles.groupBy("id").agg(F.max_by("won", F.struct("seq", "won")).alias("won"), F.max("won").alias("ever"))
    n = F.greatest(F.coalesce(F.size(F.array_distinct("source_sessions")), F.lit(0)), F.lit(0))
    j = facts.join(last, "id", "left")
    changed = {
        "is_current": F.coalesce("won", "is_current"),
        "valid_until": F.when(F.col("won"), F.lit(None).cast("timestamp")).when(~F.col("won"), now).otherwise(F.col("valid_until")),
        "confidence": F.when(F.col("ever"), F.least(F.lit(0.95), F.round(0.8 + 0.05 * n, 4))).otherwise(F.col("confidence")),
        "extraction_method": F.when(F.col("ever"), "consolidated").otherwise(F.col("extraction_method")),
    }
    out = j.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in facts.columns])
    return out, done.select(F.col("winner_id").alias("start_id"), F.lit("SUPERSEDES").alias("type"), F.col("loser_id").alias("end_id")).distinct()


def merge_duplicates(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(keep_id, subject, predicate, object, polarity, n, n_sources, confidence) of current facts that state
    the same twice or more: the earliest is kept, with all sources and min(1, max(best, .6 + .1 n_sources)).

    Sources are counted as distinct pairs in two steps, so no group is collected.
    """
    key = [*(by or []), "subject", "predicate", "object", "polarity"]
    cur = facts.where("is_current")
    groups = cur.groupBy(*key).agg(
        F.min(F.struct(F.coalesce("valid_from", epoch()).alias("t"), F.col("id").alias("id")))["id"].alias("keep_id"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c")
    ).where("n > 1")
    sources = cur.select(*key, F.explode("source_sessions").alias("s")).where("s is not null").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    m = F.coalesce("m", F.lit(0))
    conf = F.bround(F.least(F.lit(1.0), F.greatest(F.coalesce("c", F.lit(0.0)), 0.6 + 0.1 * m)), 4)
    return groups.join(sources, key, "left").select("keep_id", *key, "n", m.cast("bigint").alias("n_sources"), conf.alias("confidence"))


def close_duplicates(facts: DataFrame, now: Column, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, (keep_id, id) of what was merged away): of current facts that state the same the earliest keeps all
    sources and the confidence of :func:`merge_duplicates`, the others are closed at ``now``."""
    key = [*(by or []), "subject", "predicate", "object", "polarity"]
    cur = facts.where("is_current")
    groups = merge_duplicates(facts, by).select(*key, "keep_id", F.col("confidence").alias("c_"))
    member = cur.select(*key, "id").join(groups, key)
    away = member.where("id <> keep_id").select("keep_id", "id")
    sources = cur.select(*key, F.explode("source_sessions").alias("s")).where("s is not null").distinct().join(groups.select(*key, "keep_id"), key)
    # the distinct sources of one fact, as it will be stored
    gathered = sources.groupBy(F.col("keep_id").alias("id")).agg(F.array_sort(F.collect_set("s")).alias("s_"))
    j = facts.join(groups.select(F.col("keep_id").alias("id"), "c_"), "id", "left").join(gathered, "id", "left").join(away.select("id", F.lit(True).alias("away_")), "id", "left")
    changed = {
        "confidence": F.coalesce("c_", "confidence"), "source_sessions": F.coalesce("s_", "source_sessions"),
        "is_current": F.when(F.col("away_"), False).otherwise(F.col("is_current")), "valid_until": F.when(F.col("away_"), now).otherwise(F.col("valid_until")),
    }
    return j.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in facts.columns]), away


def predecessors(facts: DataFrame) -> DataFrame:
    """(id, previous_object): of the facts of a subject and predicate the latest with an earlier start and another
    object; of several objects of one start the largest.

    As-of self-join without a join. Facts of one start are a step; with every step goes its object and the latest
    object that differs from it. What is carried from step to step is a window within a block of time, and one row per
    block between blocks.
    """
    key = ["subject", "predicate"]
    rows = facts.where("valid_from is not null").select("id", *key, F.lower("object").alias("object"), "valid_from")
    nth = F.row_number().over(Window.partitionBy(*key, "valid_from").orderBy(F.col("object").desc()))
    two = rows.where("object is not null").select(*key, "valid_from", "object").distinct().withColumn("r_", nth).where("r_ <= 2")
    steps = two.groupBy(*key, "valid_from").agg(F.max("object").alias("o1"), F.min("object").alias("o2"))
    steps = rows.select(*key, "valid_from").distinct().join(steps, [*key, "valid_from"], "left").withColumn("block", F.date_trunc("month", "valid_from"))

    def carried(df: DataFrame, c: str, out: str) -> DataFrame:
        """The last non-null value of ``c`` before each step."""
        inside = Window.partitionBy(*key, "block").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = df.groupBy(*key, "block").agg(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("valid_from"))).alias("l_"))
        blocks = blocks.select(*key, "block", F.last("l_", ignorenulls=True).over(before).alias("b_"))
        return df.withColumn("i_", F.last(c, ignorenulls=True).over(inside)).join(blocks, [*key, "block"]).withColumn(out, F.coalesce("i_", "b_")).drop("i_", "b_")

    known = carried(steps, "o1", "p1")
    other = F.when(F.col("o1") != F.col("o2"), F.col("o2")).when(F.col("p1") != F.col("o1"), F.col("p1"))
    known = carried(known.withColumn("other_", other), "other_", "p2")
    j = rows.join(known.select(*key, "valid_from", "p1", "p2"), [*key, "valid_from"])
    return j.select("id", F.when(F.col("p1").eqNullSafe(F.col("object")), F.col("p2")).otherwise(F.col("p1")).alias("previous_object"))


def supersession(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, supersedes, superseded_by): objects of the facts a fact replaced and was replaced by, sorted."""
    obj = facts.select(F.col("id").alias("other"), "object")
    e = edges.where("type = 'SUPERSEDES'")
    out = e.select(F.col("start_id").alias("id"), F.col("end_id").alias("other")).join(obj, "other").groupBy("id").agg(F.array_sort(F.collect_set("object")).alias("supersedes"))
    back = e.select(F.col("end_id").alias("id"), F.col("start_id").alias("other")).join(obj, "other").groupBy("id").agg(F.array_sort(F.collect_set("object")).alias("superseded_by"))
    none = F.array().cast("array<string>")
    return facts.select("id").join(out, "id", "left").join(back, "id", "left").select("id", F.coalesce("supersedes", none).alias("supersedes"), F.coalesce("superseded_by", none).alias("superseded_by"))


def slot_linked(scored: DataFrame, query: str = "query_id") -> DataFrame:
    """Evidence that matched, or whose slot holds one that did (``graph_linked``); the flag by an aggregate, not a window."""
    hit = scored.where("lexical > 0").select(query, "subject", "predicate").distinct().withColumn("hit", F.lit(True))
    j = scored.join(hit, [query, "subject", "predicate"], "left")
    return j.where(F.coalesce("hit", F.lit(False)) | (F.col("lexical") > 0)).withColumn("graph_linked", F.col("lexical") <= 0).drop("hit")
