import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata.engine import MemoryEngine, Settings
from strata.plans import answer, evaluate
from strata.sources import loaders, plugins

PAYLOAD = {"sessions": [
    {"session_id": "s1", "timestamp": "2025-01-01T10:00:00", "turns": ["I live in Berlin.", {"role": "assistant", "content": "Noted."}]},
    {"session_id": "s2", "timestamp": "2025-02-01T10:00:00", "turns": [{"speaker": "user", "text": "I moved to Lagos last month."}]},
]}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    root = tmp_path_factory.mktemp("engine")
    (root / "in").mkdir()
    (root / "in" / "a.json").write_text(json.dumps(PAYLOAD))
    e = MemoryEngine(spark, f"file://{root}/store", Settings(embedder=lambda texts: [[float("blood" in t), float("blood" not in t)] for t in texts], index=lambda chunk: len(chunk)))
    e.ingest_files(f"file://{root}/in")
    yield e
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_from_files_to_answers(spark, engine):
    q = spark.createDataFrame([("a", "Where do I live?"), ("b", "What is my blood type?"), ("c", "Where did I live before Lagos?")], "query_id string, question string")
    got = {r.query_id: r for r in engine.query(q).collect()}
    assert got["a"].answer == "user lives in lagos." and got["b"].abstained and got["b"].reasons and "lived in berlin" in got["c"].answer
    engine.log_outcomes(engine.query(q), spark.createDataFrame([("a", True)], "query_id string, success boolean"))
    assert engine.store.read("outcomes").count() == 1 and engine.routing_table().count() == 1
    assert {(r.object, r.is_current, tuple(r.supersedes)) for r in engine.facts().collect()} == {("lagos", True, ("berlin",)), ("berlin", False, ())}
    c = engine.conflicts().collect()[0]
    assert c.status == "resolved" and [x.object for x in c.involved] == ["berlin", "lagos"] and c.winner_id == c.new_id
    n = {(r.kind, r.name): r.n for r in engine.stats().collect()}
    assert n["label", "Utterance"] == 3 and n["facts", "current"] == 1 and n["conflicts", "resolved"] == 1
    assert engine.verify() and engine.sessions().first().id == "s2" and engine.describe()["embedder"] == "on"
    with pytest.raises(ValueError):
        engine.query(q, force_path="nowhere")
    with pytest.raises(ValueError):
        Settings(policy="luck")


def test_scores_of_an_empty_memory(spark):
    e = {n: spark.createDataFrame([], s) for n, s in (("facts", "id string, subject string, predicate string, object string, qualifier string, polarity string, confidence double, valid_from timestamp, is_current boolean, source_sessions array<string>, evidence string"), ("utterances", "id string, text string, timestamp timestamp, session_id string, speaker string"), ("sessions", "id string, session_number int, start_time timestamp"), ("supersedes", "start_id string, end_id string"))}
    q = spark.createDataFrame([("a", "Where do I live?")], "query_id string, question string")
    r = answer.answer(q, answer.Memory(**e)).collect()[0]
    assert r.score == -1.15 and r.abstained and r.confidence == 0.0 and r.context_tokens == 0 and r.reasons[:2] == ["no entity of the question is known", "no evidence"]


def test_plugins(spark):
    r = spark.range(1).select(*[plugins.salvaged(F.lit(x)).cast("string").alias(n) for n, x in (("a", '{"x": 1}'), ("b", 'Sure: [1, 2] ok'), ("c", "nothing"))]).collect()[0]
    assert (r.a, r.b, r.c) == ('{"x":1}', "[1,2]", None)
    assert [len(c) for c in plugins.chunks([{"text": "w " * 300}, {"text": "w " * 300}, {"text": "w " * 900}, {"text": "x"}])] == [2, 1, 1]
    from strata.operators.extraction import extract

    df = spark.createDataFrame([("t", "I use Docker at home", "user"), ("u", "I use Docker", "assistant")], "id string, text string, speaker string")
    model = lambda texts: ['[{"predicate": "uses_tool", "object": "Docker", "polarity": "negative"}, {"predicate": "likes", "object": "home"}]' for _ in texts]
    got = {(x.id, x.predicate, x.object, x.polarity) for x in plugins.modelled(extract, model)(df, ["id"]).where("kind = 'fact'").collect()}
    assert {("t", "uses_tool", "docker", "negative"), ("t", "likes", "home", "positive")} <= got and not {g for g in got if g[0] == "u"}
    broken = plugins.modelled(extract, lambda texts: 1 / 0)(df, ["id"])
    assert {tuple(x) for x in broken.collect()} == {tuple(x) for x in extract(df, ["id"]).select(broken.columns).collect()}
    v = plugins.embedded(df, lambda texts: [[3.0, 4.0] for _ in texts]).first().embedding
    assert [round(x, 4) for x in v] == [0.6, 0.8] and plugins.embedded(df, None).first().embedding == []
    said = spark.createDataFrame([("1", "a b", "s", None, "user"), ("2", " ", "s", None, "user")], "id string, text string, session_id string, timestamp timestamp, speaker string")
    assert plugins.mirror(said, len) == 1 and plugins.mirror(said, lambda c: 1 / 0) == 0
    hits = spark.createDataFrame([("q", "1", 0.5), ("q", "9", 0.4)], "query_id string, id string, score double")
    assert [r.id for r in plugins.hydrated(hits, said.withColumn("score", F.lit(0))).collect()] == ["1"]


def test_record_files(spark, tmp_path):
    parallel = {"question_id": "x_abs", "question": "Q?", "question_type": "single", "answer": "A b", "haystack_sessions": [[{"role": "User", "content": "hi", "has_answer": True}, {"role": "assistant", "content": " "}]], "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_session_ids": ["h1"]}
    generic = {"id": 7, "question": "R?", "category": "c", "answer_keywords": ["Go"], "forbidden_keywords": ["Rust"], "sessions": [{"timestamp": "2025-01-01", "turns": ["bare", {"speaker": "user", "text": "t"}]}]}
    (tmp_path / "d.json").write_text(json.dumps([parallel, generic, {}]))
    samples, turns = loaders.read_samples(spark, f"file://{tmp_path}/d.json")
    got = {r.sample_id: r for r in samples.collect()}
    assert set(got) == {"x_abs", "7", "2"} and got["x_abs"].should_abstain and got["x_abs"].evidence_texts == ["hi"] and got["x_abs"].answer_keywords == ["a b"] and got["7"].forbidden_keywords == ["rust"] and got["2"].category == "unknown"
    assert sorted((r.sample_id, r.session_pos, r.turn_pos, r.speaker, r.text, r.stamp) for r in turns.collect()) == [("7", 0, 0, "user", "bare", "2025-01-01"), ("7", 0, 1, "user", "t", "2025-01-01"), ("x_abs", 0, 0, "user", "hi", "2023/05/20 (Sat) 02:21")]
    assert loaders.load_dataset(spark, f"{tmp_path}/none.json", 5)[2] == "synthetic"


def test_baselines_and_harness(spark):
    samples, turns = loaders.samples_of(loaders.synthetic(spark, 10, 4))
    samples, turns = samples.cache(), turns.cache()
    got = {n: evaluate.baseline_metrics(evaluate.baseline(n, turns, samples, 40)).first() for n in evaluate.BASELINES}
    assert got["full-context"].recall == 1.0 and got["full-context"].unanswerable == 0.0 and got["recency"].recall < 1.0
    assert got["recency"].mean_tokens <= 60 and got["lexical-topk"].n == 10
    r = evaluate.run(samples, turns, now=F.lit(datetime(2025, 3, 1))).cache()
    m = evaluate.metrics(r).first()
    # facts answer in their own words, so a context without the sentence itself counts as a miss
    assert m.n == 10 and m.accuracy >= 0.8 and m.abstain_recall == 1.0 and m.context_recall is not None
    assert r.where("should_abstain and abstained").count() >= 1
    assert "accuracy" in evaluate.report(evaluate.metrics(r))
    with pytest.raises(ValueError):
        evaluate.ablation(samples, turns, ["nothing"])
    with pytest.raises(ValueError):
        evaluate.retrieve("nothing", turns, samples)


def test_resolution_scores(spark):
    e = spark.createDataFrame([("s", "lives_in", "x"), ("s", "likes", "y")], "sample_id string, predicate string, object string")
    c = spark.createDataFrame([("s", "lives_in", "f1"), ("s", "likes", "f2")], "sample_id string, predicate string, winner_id string")
    f = spark.createDataFrame([("f1", "x"), ("f2", "z")], "id string, object string")
    assert [tuple(r) for r in evaluate.resolution_scores(e, c, f).collect()] == [("s", 2, 1)]
