"""The property graph as tables: nodes(id, label, ...) per label and edges(start_id, type, end_id, props)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.predicates import where
from strata.session import read_table

#: label to layer
LAYERS = {"Session": "episodic", "Turn": "episodic", "Utterance": "episodic", "Entity": "semantic", "Fact": "semantic", "Conflict": "semantic", "QueryType": "procedural", "RetrievalPath": "procedural", "Outcome": "procedural"}
TABLES = {"Session": "sessions", "Turn": "turns", "Utterance": "utterances", "Fact": "facts", "Entity": "entities"}


def node_table(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Distinct rows of a label's table (rows may be repeated)."""
    df = read_table(spark, sf_dir, TABLES[label])
    return df.dropDuplicates(["id"]) if label != "Turn" else df.distinct()


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label) of every node."""
    parts = [read_table(spark, sf_dir, t).select("id", F.lit(label).alias("label")).distinct() for label, t in TABLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, start: str, kind: str, end: str) -> DataFrame:
    return df.select(F.col(start).alias("start_id"), F.lit(kind).alias("type"), F.col(end).alias("end_id")).where("start_id is not null and end_id is not null").distinct()


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_TURN, HAS_UTTERANCE, NEXT within a session, DERIVED_FROM (fact to session); unique by start, type and end."""
    turns = read_table(spark, sf_dir, "turns")
    said = read_table(spark, sf_dir, "utterances")
    facts = read_table(spark, sf_dir, "facts").select("id", F.explode("source_sessions").alias("session"))
    chain = turn_chain(turns).where("next_id is not null")
    return (
        _edge(turns, "session_id", "HAS_TURN", "id")
        .unionByName(_edge(said, "turn_id", "HAS_UTTERANCE", "id"))
        .unionByName(_edge(chain, "id", "NEXT", "next_id"))
        .unionByName(_edge(facts, "id", "DERIVED_FROM", "session"))
    )


def turn_chain(turns: DataFrame) -> DataFrame:
    """(session_id, turn_number, id, previous_id, next_id): neighbours by turn number, then id.

    The window is cut into blocks of turn numbers, whose borders meet through one
    row each, so a session of any length is spread over tasks.
    """
    rows = turns.where("session_id is not null and turn_number is not null").select("session_id", "turn_number", "id").distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn_number") / 16).cast("int"))
    w = Window.partitionBy("session_id", "block").orderBy("turn_number", "id")
    inner = rows.select("*", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    s = F.struct("turn_number", "id")
    edges = rows.groupBy("session_id", "block").agg(F.min(s)["id"].alias("first"), F.max(s)["id"].alias("last"))
    b = Window.partitionBy("session_id").orderBy("block")
    edges = edges.select("session_id", "block", F.lag("last").over(b).alias("before"), F.lead("first").over(b).alias("after"))
    return inner.join(edges, ["session_id", "block"]).select("session_id", "turn_number", "id", F.coalesce("p", "before").alias("previous_id"), F.coalesce("n", "after").alias("next_id"))


def session_chain(sessions: DataFrame) -> DataFrame:
    """(user_id, id, previous_id): the session of the user that started before, in blocks of months."""
    rows = sessions.select("user_id", "id", "start_time").distinct().withColumn("block", F.date_trunc("month", "start_time"))
    w = Window.partitionBy("user_id", "block").orderBy("start_time", "id")
    inner = rows.select("*", F.lag("id").over(w).alias("p"))
    last = rows.groupBy("user_id", "block").agg(F.max(F.struct("start_time", "id"))["id"].alias("last"))
    last = last.select("user_id", "block", F.lag("last").over(Window.partitionBy("user_id").orderBy("block")).alias("before"))
    return inner.join(last, [inner.user_id.eqNullSafe(last.user_id), inner.block.eqNullSafe(last.block)]).select(inner.user_id, "id", F.coalesce("p", "before").alias("previous_id"))


def expand(edges: DataFrame, anchors: DataFrame, types: Sequence[str] | None = None, direction: str = "out", targets: DataFrame | None = None, tests: Mapping[str, Any] | None = None) -> DataFrame:
    """One hop: (anchor_id, type, other_id) from ``anchors`` (id). Anchors count once; ``targets`` (id, ...)
    with ``tests`` restricts the other end by a join, never by a lookup per row."""
    ids = anchors.select(F.col("id").alias("anchor_id")).where("anchor_id is not null").distinct()
    e = edges.where(F.col("type").isin(list(types))) if types else edges
    out = ids.join(e.select(F.col("start_id").alias("anchor_id"), "type", F.col("end_id").alias("other_id")), "anchor_id")
    back = ids.join(e.select(F.col("end_id").alias("anchor_id"), "type", F.col("start_id").alias("other_id")), "anchor_id")
    found = {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()
    if targets is not None:
        found = found.join(where(targets, tests).select(F.col("id").alias("other_id")).distinct(), "other_id", "left_semi")
    return found.select("anchor_id", "type", "other_id")


def paths(edges: DataFrame, sources: DataFrame, types: Sequence[str] | None = None, direction: str = "out", max_len: int = 3, path_count: int = 40, result_limit: int | None = 400) -> DataFrame:
    """Bounded simple paths: (source_id, depth, nodes), at most ``path_count`` per source, shortest first,
    then by node ids, and ``result_limit`` in all.

    Each level is one join. Since only the first ``path_count`` paths of a source
    can be kept, in the order (depth, nodes), each level keeps no more per source
    than that, which bounds a hub without changing the result.
    """
    e = edges.where(F.col("type").isin(list(types))) if types else edges
    step = e.select(F.col("start_id").alias("at"), F.col("end_id").alias("to"))
    if direction != "out":
        back = e.select(F.col("end_id").alias("at"), F.col("start_id").alias("to"))
        step = back if direction == "in" else step.unionByName(back)
    step = step.distinct()
    level = sources.select(F.col("id").alias("source_id")).distinct().select("source_id", F.array("source_id").alias("nodes"))
    found = None
    for depth in range(1, max_len + 1):
        grown = level.withColumn("at", F.element_at("nodes", -1)).join(step, "at").where(~F.expr("array_contains(nodes, to)"))
        grown = grown.select("source_id", F.concat("nodes", F.array("to")).alias("nodes"))
        # a level's cut is by sorted nodes in two steps, so a hub is cut before it meets in one task
        level = _first_per(_first_per(grown.withColumn("part", F.pmod(F.xxhash64("nodes"), F.lit(32))), ["source_id", "part"], path_count).drop("part"), ["source_id"], path_count)
        kept = level.withColumn("depth", F.lit(depth))
        found = kept if found is None else found.unionByName(kept)
    order = Window.partitionBy("source_id").orderBy("depth", "nodes")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= path_count).drop("n")
    best = best.select("source_id", "depth", "nodes")
    return best if result_limit is None else best.orderBy("source_id", "depth", "nodes").limit(result_limit)


def _first_per(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("nodes")
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n) by label, edge type and layer; labels that begin with __ are hidden."""
    shown = nodes.where(~F.startswith("label", F.lit("__")))
    layer = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    by = lambda df, kind, c: df.groupBy(c.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(shown, "label", F.col("label")).unionByName(by(edges, "type", F.col("type"))).unionByName(by(shown, "layer", F.coalesce(F.try_element_at(layer, F.col("label")), F.lit("other"))))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "start_id"), "start_id", "left_semi").join(keep.withColumnRenamed("id", "end_id"), "end_id", "left_semi")


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` that aren't there yet, unique by start, type and end."""
    key = ["start_id", "type", "end_id"]
    return edges.unionByName(new.select(*edges.columns).dropDuplicates(key).join(edges, key, "left_anti"))


def upsert_edges(edges: DataFrame, new: DataFrame, seq: Column) -> DataFrame:
    """Of edges with one start, type and end the row with the highest ``seq``, new rows before old ones."""
    key = ["start_id", "type", "end_id"]
    both = edges.withColumn("new_", F.lit(0)).withColumn("seq_", F.lit(0).cast("long")).unionByName(new.withColumn("new_", F.lit(1)).withColumn("seq_", seq.cast("long")))
    others = [c for c in edges.columns if c not in key]
    top = both.groupBy(*key).agg(F.max_by(F.struct(*others) if others else F.lit(1), F.struct("new_", "seq_")).alias("r"))
    return top.select(*key, *[F.col(f"r.{c}").alias(c) for c in others])


def merge_nodes(nodes: DataFrame, new: DataFrame, key: str, on_match: Mapping[str, Column] | None = None) -> DataFrame:
    """Node upsert by ``key``: unknown keys are added, known ones updated by ``on_match`` (``n_`` prefixed
    columns are those of the new row). One full outer join, no rewrite of rows in place."""
    fresh = new.dropDuplicates([key]).select(*[F.col(c).alias(f"n_{c}") for c in nodes.columns if c in new.columns])
    j = nodes.join(fresh, nodes[key] == fresh[f"n_{key}"], "full_outer")
    known = nodes[key].isNotNull() & F.col(f"n_{key}").isNotNull()
    cols = []
    for c in nodes.columns:
        there = F.col(f"n_{c}") if c in new.columns else F.lit(None).cast(nodes.schema[c].dataType)
        change = F.when(known, on_match[c]) if on_match and c in on_match else F.lit(None)
        cols.append(F.coalesce(change, nodes[c], there).alias(c))
    return j.select(*cols)


def set_props(nodes: DataFrame, updates: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Shallow update by key: the columns of ``updates`` replace those of the row it names, null included, all else
    stays. With ``strict`` an unknown key is an error (KeyError)."""
    changed = [c for c in updates.columns if c != key]
    if strict and (lost := updates.join(nodes, key, "left_anti").select(key).limit(1).collect()):
        raise KeyError(lost[0][0])
    new = updates.dropDuplicates([key]).select(key, F.lit(True).alias("known_"), *[F.col(c).alias(f"u_{c}") for c in changed])
    j = nodes.join(new, key, "left")
    return j.select(*[F.when(F.col("known_"), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in nodes.columns])


def node_titles(nodes: DataFrame, label: str) -> DataFrame:
    """(id, title) of the nodes of a label for display."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.col("session_number") if label == "Session" else F.lit(None)
    titles = {
        "Fact": lambda: F.concat(text("predicate"), F.lit(": "), text("object")), "Entity": lambda: text("canonical_name"),
        "Session": lambda: F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(F.lit("session "), number.cast("string"))).otherwise(F.coalesce(F.date_format("start_time", "yyyy-MM-dd"), F.lit("unknown date"))),
        "Turn": lambda: F.concat(text("speaker"), F.lit(" #"), F.coalesce("turn_number", F.lit(0)).cast("string")), "Utterance": lambda: F.substring(text("text"), 1, 60),
        "Conflict": lambda: F.concat(text("predicate"), F.lit(" ("), text("status"), F.lit(")")), "QueryType": lambda: text("name"), "RetrievalPath": lambda: text("name"),
        "Outcome": lambda: F.concat(text("query_type"), F.when(F.col("success"), " ok").otherwise(" fail")),
    }
    return nodes.select("id", titles.get(label, lambda: F.substring(text("id"), 1, 24))().alias("title"))


def sample(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """At least four nodes per label (smallest ids), ``limit`` spread over the labels, and the edges among them."""
    per = max(4, limit // max(1, len(TABLES)))
    ranked = nodes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("label", "part").orderBy("id"))).where(F.col("r") <= per)
    picked = top.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("r") <= per).select("id", "label")
    return picked, induced(edges, picked)
