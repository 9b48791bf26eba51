import json

from pyspark.sql import types as T

from strata import training
from strata.operators import nested as N

S = {"session_id": "s", "turns": [None, "hi", {"speaker": " Bot ", "text": "", "content": [{"type": "text", "text": "yes"}, {"type": "image"}], "attachments": ["a.txt", None, {"name": "b"}, {"kind": "x"}, {"name": " "}]}, {"role": "user"}, 7]}
PAYLOADS = [json.dumps(S), json.dumps([None, S]), json.dumps({"sessions": [S]}), json.dumps({"export": {"sessions": [S]}}), json.dumps({"data": json.dumps([S])}), json.dumps(S)[:-3], json.dumps(S) + " x", json.dumps(S) + json.dumps(S), "", "null", "[]", None, "[{]", "5", '"text"']
LABELS = {(0, 1, -1, "user"), (0, 2, -1, "bot"), (0, 2, 0, "a.txt"), (0, 2, 2, "b")}


def test_wrappers_positions_and_damage(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAYLOADS)) + [(0, PAYLOADS[0])], "record_id bigint, payload string").write.parquet(f"{tmp_path}/demo_user.parquet")
    got = {}
    for r in training.p5_found(spark, str(tmp_path)).collect():
        got.setdefault(r.record_id, []).append((r.session_pos, r.turn_pos, r.att_pos, r.label))
    assert sorted(got) == [0, 1, 2, 3, 4]
    for i, rows in got.items():
        shift = {(p + (i == 1), *rest) for p, *rest in LABELS}
        assert sorted(rows) == sorted(shift)


def test_attachment_rows_keep_their_parents(spark):
    df = spark.createDataFrame([(1, PAYLOADS[0])], "record_id bigint, payload string")
    rows = N.attachment_rows(N.turn_rows(N.session_rows(df))).collect()
    assert {(r.record_id, r.turn_pos, r.att_pos, r.name) for r in rows} == {(1, 2, 0, "a.txt"), (1, 2, 2, "b")}


def test_every_planned_table_has_rows_and_keys(spark):
    payload = """{"sessions": [null, {"session_id": "s", "client": {"app": "a", "build": {"major": 2, "tags": ["x", "y"]}}, "turns": [
      {"speaker": "u", "text": "t", "meta": {"lang": "en"}, "attachments": [{"name": "n", "kind": "k", "refs": [{"turn": 3}, {"turn": 4}]}, "bare"]}]}]}"""
    t = N.tables(spark.createDataFrame([(7, payload)], "record_id bigint, payload string"))
    rows = {n: [tuple(r) for r in df.orderBy(*df.columns[:-1]).collect()] for n, df in t.items()}
    assert set(rows) == {"session", "turn", "attachment", "tag", "ref"}
    assert rows["tag"] == [(7, 1, 0, "x"), (7, 1, 1, "y")]
    assert [(r.record_id, r.session_pos, r.client_app, r.client_build_major) for r in t["session"].collect()] == [(7, 1, "a", 2)]
    assert [(r.turn_pos, r.speaker, r.meta_lang) for r in t["turn"].collect()] == [(0, "u", "en")]
    assert {(r.session_pos, r.turn_pos, r.att_pos, r.bare, r.name) for r in t["attachment"].collect()} == {(1, 0, 0, None, "n"), (1, 0, 1, "bare", None)}
    assert {(r.att_pos, r.ref_pos, r.turn) for r in t["ref"].collect()} == {(0, 0, 3), (0, 1, 4)}


def test_shared_inlining_plan():
    plan = N.plan_relations(N.SESSION_GRAPH, "record")
    assert set(plan) == {"record", "session", "turn", "attachment", "tag", "ref"}
    assert {"client_app", "client_build_major"} <= set(plan["session"].columns) and "meta_lang" in plan["turn"].columns
    shared = {"a": N.Element({}, {"x": ("p", False), "y": ("p", False), "c": ("n", False)}), "p": N.Element({"v": "int"}), "n": N.Element({}, {"child": ("n", False)})}
    plan = N.plan_relations(shared, "a")
    assert set(plan) == {"a", "p", "n"} and plan["p"].parents == [("a", "$.x"), ("a", "$.y")] and ("n", "$.child") in plan["n"].parents
    st = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("o", T.StructType([T.StructField("z", T.IntegerType())]))])
    plan = N.plan_relations(N.schema_graph(st), "root")
    assert set(plan) == {"root", "tags"} and plan["root"].columns == {"id": ("$.id", "bigint"), "o_z": ("$.o.z", "int")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id bigint, payload string")
    assert N.turn_rows(N.session_rows(df)).count() == 0
