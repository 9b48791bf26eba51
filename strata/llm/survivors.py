"""One surviving record per group of duplicates, chosen and built field by field.

A group is all ids that state the same thing: equal subject, predicate and
polarity, and objects equal apart from case, accents, spacing, punctuation and a
leading article. Members rank by trust (confidence), support (number of distinct
sources), recency (valid_from) and id.

Everything is an algebraic aggregate (smallest struct, distinct pairs counted in
two steps), so a group that holds a third of all rows is reduced on the map side
and never collected.

Where timestamps are missing, *currency reasoning* decides which value of a field
is the latest: from timestamped rows it learns how often one value gives way to
another, keeps the precedences that are not contradicted with all that follows
from them, and takes the newest timestamped value of a group unless values
without a timestamp come after it in that order.

Defined cases: repeated rows count once; null confidence and valid_from rank
last; null or repeated sources don't count; a null subject, predicate, polarity
or object, or an object without letters or digits, belongs to no group; an empty
table gives no rows; ties end at the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import loose_key, visible
from strata.session import cut

KEY = ("subject", "predicate", "polarity", "key")
#: fields of the built record that come from the best-ranked member that has one
FIELDS = ("object", "confidence", "valid_from")
#: fields whose value changes with time, and what makes a transition between two values a precedence
CURRENT = ("qualifier", "extraction_method")
LEAST, SURE = 3, 2.0


def keyed(facts: DataFrame) -> DataFrame:
    """Facts with their group key; keyless rows are left out."""
    return facts.withColumn("key", loose_key(F.col("object"))).where("subject is not null and predicate is not null and polarity is not null and key <> ''")


def rank_struct() -> Column:
    """Smaller is better."""
    sources = F.array_distinct(F.filter(F.coalesce("source_sessions", F.array().cast("array<string>")), lambda s: s.isNotNull()))
    return F.struct(
        F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("trust"),
        (-F.size(sources)).alias("support"),
        F.coalesce(-F.unix_micros("valid_from"), F.lit(2**62)).alias("age"),
        F.col("id").alias("id"),
    )


def members(facts: DataFrame) -> DataFrame:
    """One row per group key and id (repeats merged) with its rank, evidence and sources."""
    return keyed(facts).select(*KEY, "id", rank_struct().alias("rank"), F.when(visible(F.col("evidence")), F.lit(True)).alias("has_evidence"), "source_sessions")


def survivors(facts: DataFrame) -> DataFrame:
    """(group_id, survivor_id, evidence_id, n_members, n_sources) per group of two or more ids."""
    rows = members(facts)
    # first by id, which merges repeats and is as fine as the data; then by group
    by_id = rows.groupBy(*KEY, "id").agg(F.min("rank").alias("rank"), F.max("has_evidence").alias("has_evidence"))
    groups = by_id.groupBy(*KEY).agg(
        F.min("id").alias("group_id"),
        F.min("rank").getField("id").alias("survivor_id"),
        F.coalesce(F.min(F.when(F.col("has_evidence"), F.col("rank"))).getField("id"), F.lit("")).alias("evidence_id"),
        F.count(F.lit(1)).cast("int").alias("n_members"),
    ).where("n_members > 1")
    sources = (
        rows.select(*KEY, F.explode("source_sessions").alias("s")).where("s is not null").distinct()
        .groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("n_sources"))
    )
    return groups.join(sources, list(KEY), "left").select("group_id", "survivor_id", "evidence_id", "n_members", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def _values(rows: DataFrame, fields: tuple[str, ...], *keep: str) -> DataFrame:
    """(*keep, field, v): a row per field that has a visible value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("f")
    return rows.select(*keep, each).select(*keep, "f.field", "f.v").where(visible(F.col("v")))


def transitions(facts: DataFrame, fields: tuple[str, ...] = CURRENT, chain: tuple[str, ...] = ("subject", "predicate")) -> DataFrame:
    """(field, earlier, later, n): how often timestamped rows of a chain go from one value of a field to another.

    A chain is cut into months, each read in order; a month's last value is
    followed by the next month's first, so no chain is ever in one task.
    """
    rows = _values(facts.where("valid_from is not null"), fields, *chain, "id", "valid_from").withColumnRenamed("valid_from", "at").distinct().withColumn("block", F.date_trunc("month", "at"))
    key = ["field", *chain]
    w = Window.partitionBy(*key, "block").orderBy("at", "id")
    inside = rows.select("field", "v", F.lead("v").over(w).alias("w")).where("w is not null")
    edge = rows.groupBy(*key, "block").agg(F.min(F.struct("at", "id", "v")).getField("v").alias("first"), F.max(F.struct("at", "id", "v")).getField("v").alias("last"))
    across = edge.select("field", F.col("last").alias("v"), F.lead("first").over(Window.partitionBy(*key).orderBy("block")).alias("w")).where("w is not null")
    return inside.unionByName(across).where("v <> w").groupBy("field", F.col("v").alias("earlier"), F.col("w").alias("later")).agg(F.count(F.lit(1)).alias("n"))


def precedence(trans: DataFrame, least: int = LEAST, sure: float = SURE) -> DataFrame:
    """Transitions with ``back``, how often the reverse occurs, and ``precedes``: seen ``least`` times and more often
    than its reverse by ``sure`` standard deviations of a fair coin."""
    back = trans.select("field", F.col("earlier").alias("later"), F.col("later").alias("earlier"), F.col("n").alias("back"))
    j = trans.join(back, ["field", "earlier", "later"], "left").withColumn("back", F.coalesce("back", F.lit(0).cast("bigint")))
    return j.withColumn("precedes", (F.col("n") >= least) & (F.col("n") - F.col("back") >= sure * F.sqrt(F.col("n") + F.col("back"))))


def closed(edges: DataFrame) -> DataFrame:
    """(field, earlier, later) for every pair joined by a path of edges, paths doubling in length each round;
    values that precede each other (a cycle) contradict themselves and are left unordered."""
    reach, n = cut(edges.select("field", "earlier", "later").distinct(), "precedence"), -1
    while n != (n := reach.count()):
        longer = reach.select("field", "earlier", F.col("later").alias("mid")).join(reach.select("field", F.col("earlier").alias("mid"), "later"), ["field", "mid"]).select("field", "earlier", "later")
        reach = cut(reach.unionByName(longer).distinct(), "precedence")
    return reach.join(reach.select("field", F.col("later").alias("earlier"), F.col("earlier").alias("later")), ["field", "earlier", "later"], "left_anti")


def latest_values(facts: DataFrame, fields: tuple[str, ...] = CURRENT, least: int = LEAST, sure: float = SURE) -> DataFrame:
    """(group_id, field, value, decided) per group: the newest timestamped value, unless values without a timestamp
    follow it in the learned order, which is transitive; then, or if no row has a timestamp, what no other such value
    follows: among several tops the one with the most rows, then the smallest. ``decided`` says what settled it:
    ``date``, ``order`` or ``rows``."""
    order = closed(precedence(transitions(facts, fields), least, sure).where("precedes"))
    key = [*KEY, "field"]
    rows = _values(keyed(facts), fields, *KEY, "id", "valid_from")
    groups = keyed(facts).groupBy(*KEY).agg(F.min("id").alias("group_id"), F.max("id").alias("last")).where("group_id <> last").drop("last")
    newest = rows.where("valid_from is not null").groupBy(*key).agg(F.max(F.struct("valid_from", "id", "v")).getField("v").alias("dated"))
    undated = rows.where("valid_from is null").groupBy(*key, "v").agg(F.countDistinct("id").alias("rows")).join(newest, key, "left")
    follows = undated.where("dated is not null").join(order.select("field", F.col("earlier").alias("dated"), F.col("later").alias("v")), ["field", "dated", "v"], "left_semi")
    cand = undated.where("dated is null").unionByName(follows).select(*key, "v", "rows")
    # from a value to those that follow it, then whether the group has one: values never meet pair by pair
    beaten = cand.join(order.withColumnRenamed("earlier", "v"), ["field", "v"]).join(cand.select(*key, F.col("v").alias("later")), [*key, "later"], "left_semi").select(*key, "v").distinct()
    # the order has no cycles, so candidates always leave a top
    tops = cand.join(beaten.withColumn("below", F.lit(True)), [*key, "v"], "left").groupBy(*key).agg(
        F.min(F.when(F.col("below").isNull(), F.struct((-F.col("rows")).alias("r"), "v"))).getField("v").alias("top"), F.coalesce(F.max("below"), F.lit(False)).alias("ordered")
    )
    decided = F.when(F.col("top").isNull(), "date").when(F.col("dated").isNotNull() | F.col("ordered"), "order").otherwise("rows")
    best = newest.join(tops, key, "full").select(*key, F.coalesce("top", "dated").alias("value"), decided.alias("decided"))
    return groups.join(best, list(KEY)).select("group_id", "field", "value", "decided")


def surviving_records(facts: DataFrame) -> DataFrame:
    """The built record of each group: each field from the best-ranked member that has it, the latest value of those
    that change, gathered sources count."""
    core = survivors(facts)
    rows = keyed(facts).select(*KEY, "id", rank_struct().alias("rank"), *FIELDS, F.when(visible(F.col("evidence")), F.col("evidence")).alias("evidence"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", c))).getField(c).alias(c)
    built = rows.groupBy(*KEY).agg(F.min("id").alias("group_id"), *[first(c) for c in (*FIELDS, "evidence")]).drop(*KEY)
    values = latest_values(facts).groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in CURRENT])
    records = core.join(built, "group_id", "left").join(values, "group_id", "left")
    return records.select("group_id", "evidence_id", "survivor_id", "n_members", "n_sources", *FIELDS, "evidence", *CURRENT)


def gathered(facts: DataFrame) -> DataFrame:
    """(group_id, field, value) of all distinct source_sessions and evidence of each group: a child
    table of the records, so that a hot group is never collected into one row."""
    rows = keyed(facts)
    groups = rows.groupBy(*KEY).agg(F.min("id").alias("group_id"), F.max("id").alias("last")).where("group_id <> last").drop("last")
    sources = rows.select(*KEY, F.lit("source_sessions").alias("field"), F.explode("source_sessions").alias("value")).where("value is not null")
    said = rows.where(visible(F.col("evidence"))).select(*KEY, F.lit("evidence").alias("field"), F.col("evidence").alias("value"))
    return sources.unionByName(said).distinct().join(groups, list(KEY)).select("group_id", "field", "value")
