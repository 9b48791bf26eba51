"""The engine as one object: a store, its settings and what may be plugged in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import facts as fact_ops
from strata.operators import graph, routing
from strata.operators.extraction import extract
from strata.plans import answer as plan
from strata.plans import intake
from strata.sources import loaders, plugins
from strata.sources.store import GraphStore

OUTCOMES = "query_id string, path string, query_type string, success boolean, abstained boolean, latency_ms bigint, tokens_used bigint, timestamp timestamp"
VECTORS = "id string, embedding array<float>"


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; each may be overridden per call."""

    policy: str = "recency"
    max_conflicts: int = 200
    context_tokens: int = 6000
    explore: bool = False
    embedder: Callable[[list[str]], list[list[float]]] | None = field(default=None, compare=False)
    model: Callable[[list[str]], list[str]] | None = field(default=None, compare=False)
    index: Callable[[list[dict]], int] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.policy not in fact_ops.POLICIES:
            raise ValueError(f"unknown policy {self.policy!r}")


class MemoryEngine:
    """Ingest, consolidate, answer and learn over one store. Every change is one version; readers see whole ones."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.settings, self.store = spark, settings or Settings(), GraphStore(spark, path)
        if not self.store.tables():
            types, paths = routing.seeds(spark)
            empty = {"outcomes": spark.createDataFrame([], OUTCOMES), "vectors": spark.createDataFrame([], VECTORS)}
            self.store.commit({**intake.State.empty(spark).tables(), **empty, "query_types": types, "paths": paths})

    def state(self) -> intake.State:
        return intake.State(**{n: self.store.read(n) for n in intake.SCHEMAS})

    def ingest(self, sessions: DataFrame, turns: DataFrame) -> DataFrame:
        """Counters per session that was new. The external index is told after the commit, as far as it answers."""
        before = self.state()
        extractor = plugins.modelled(extract, self.settings.model)
        after, report = intake.intake(sessions, turns, before, extractor, "rule-based" if self.settings.model is None else "llm-extract")
        said = after.utterances.join(before.utterances.select("id"), "id", "left_anti")
        stated = after.facts.join(before.facts.select("id"), "id", "left_anti").select("id", F.concat_ws(" ", "subject", F.replace("base_predicate", F.lit("_"), F.lit(" ")), "object", "qualifier").alias("text"))
        changed = {"entities": after.entities, "facts": after.facts}
        fresh = lambda n, key: getattr(after, n).join(getattr(before, n).select(*key), key, "left_anti").select(getattr(before, n).columns)
        more = {n: fresh(n, ["tenant", "id"]) for n in ("sessions", "turns", "conflicts")} | {"edges": fresh("edges", ["start_id", "type", "end_id"]), "utterances": said.select(before.utterances.columns)}
        if self.settings.embedder is not None:
            more["vectors"] = plugins.embedded(said.select("id", "text").unionByName(stated), self.settings.embedder).where(F.size("embedding") > 0).select("id", "embedding")
        self.store.commit(changed, more)
        if self.settings.index is not None:
            plugins.mirror(said, self.settings.index)
        return report

    def ingest_files(self, path: str, consolidate: bool = True) -> DataFrame:
        """All sessions of JSON files, then a consolidation."""
        sessions, turns = loaders.parse_sessions(loaders.read_sessions(self.spark, path))
        report = self.ingest(sessions, turns)
        if consolidate:
            self.consolidate()
        return report

    def consolidate(self, policy: str | None = None, now: Column | None = None, limit: int | None = None) -> DataFrame:
        after, report = intake.sleep(self.state(), policy or self.settings.policy, now, limit or self.settings.max_conflicts)
        self.store.commit({"facts": after.facts, "conflicts": after.conflicts, "edges": after.edges})
        return report

    def query(self, questions: DataFrame, **switches) -> DataFrame:
        """Answers to questions (query_id, question); switches as of :func:`strata.plans.answer.answer`."""
        vectors = None
        if self.settings.embedder is not None:
            vectors = self.store.read("vectors")
            questions = plugins.embedded(questions, self.settings.embedder, "question", "vector")
        given = {"max_tokens": self.settings.context_tokens, "explore": self.settings.explore, **switches}
        return plan.answer(questions, plan.Memory.of(self.state(), vectors), routing.rates(self.store.read("outcomes")), **given)

    def log_outcomes(self, answers: DataFrame, success: DataFrame, at: Column | None = None) -> None:
        """Feedback (query_id, success) on answers; the routing learns from it."""
        rows = plan.outcomes(answers, success, at if at is not None else F.current_timestamp())
        self.store.commit(appended={"outcomes": rows.select(self.store.read("outcomes").columns)})

    def stats(self) -> DataFrame:
        """(kind, name, n): nodes by label and layer, edges by type, conflicts by status, facts current or not."""
        s = self.state()
        nodes = None
        for label, name in (("Session", "sessions"), ("Turn", "turns"), ("Utterance", "utterances"), ("Entity", "entities"), ("Fact", "facts"), ("Conflict", "conflicts")):
            rows = getattr(s, name).select("id", F.lit(label).alias("label"))
            nodes = rows if nodes is None else nodes.unionByName(rows)
        out = graph.stats(nodes, s.edges)
        out = out.unionByName(s.conflicts.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("conflicts").alias("kind"), "name", "n"))
        held = F.when(F.col("is_current"), "current").otherwise("superseded").alias("name")
        return out.unionByName(s.facts.groupBy(held).agg(F.count(F.lit(1)).alias("n")).select(F.lit("facts").alias("kind"), "name", "n"))

    def facts(self, subject: str | None = None, only_current: bool = False, limit: int = 100) -> DataFrame:
        """Facts, newest first, with what they replaced and were replaced by."""
        s = self.state()
        f = s.facts if subject is None else s.facts.where(F.col("subject") == subject)
        f = (f.where("is_current") if only_current else f).orderBy(F.col("valid_from").desc_nulls_last(), "id").limit(limit)
        return f.join(fact_ops.supersession(s.facts, s.edges), "id", "left")

    def conflicts(self, limit: int = 100) -> DataFrame:
        """Conflicts, newest first, with both facts by their start and the winner's id."""
        s = self.state()
        c = s.conflicts.orderBy(F.col("detected_at").desc_nulls_last(), "id").limit(limit)
        sides = c.select("id", F.explode(F.array("existing_id", "new_id")).alias("fact_id")).join(s.facts.select(F.col("id").alias("fact_id"), "object", "valid_from"), "fact_id")
        involved = sides.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("valid_from", "fact_id", "object"))).alias("involved"))
        won = s.edges.where("type = 'RESOLVED_TO'").select(F.col("start_id").alias("id"), F.col("end_id").alias("winner_id"))
        return c.join(involved, "id", "left").join(won, "id", "left")

    def sessions(self, limit: int = 100) -> DataFrame:
        return self.state().sessions.orderBy(F.col("start_time").desc_nulls_last(), "id").limit(limit)

    def routing_table(self) -> DataFrame:
        return routing.routing_table(routing.rates(self.store.read("outcomes")))

    def verify(self) -> bool:
        return self.store.verify()

    def describe(self) -> dict[str, object]:
        s = self.settings
        return {"path": self.store.versions.path, "tables": self.store.tables(), "policy": s.policy, **plugins.describe(s.embedder, s.model, s.index)}

    def reset(self) -> None:
        self.store.reset()
        self.__init__(self.spark, self.store.versions.path, self.settings)
