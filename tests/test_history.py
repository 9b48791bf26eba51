import random
from datetime import datetime, timedelta

import pytest

from strata.operators import history as H

SCHEMA = "subject string, predicate string, value string, positive boolean, at timestamp, recorded timestamp"
DAY0 = datetime(2025, 1, 1)


def brute(rows):
    chains = {}
    for s, p, v, pos, at, rec in set(rows):
        if None in (s, p, v, at):
            continue
        old = chains.setdefault((s, p), {}).get(at)
        new = (rec or datetime.min, pos, v)
        if old is None or new > old:
            chains[s, p][at] = new
    out = set()
    for (s, p), c in chains.items():
        cur = None
        for at in sorted(c):
            _, pos, v = c[at]
            if pos and (cur is None or cur[0] != v):
                if cur:
                    out.add((s, p, *cur, at))
                cur = (v, at)
            elif not pos and cur and cur[0] == v:
                out.add((s, p, *cur, at))
                cur = None
        if cur:
            out.add((s, p, *cur, None))
    return out


def rows_of(seed, n=300):
    r = random.Random(seed)
    return [(r.choice("ab"), "p", r.choice(["x", "y", "z"]), r.random() < 0.75, DAY0 + timedelta(days=r.randint(0, 200)), DAY0 + timedelta(days=r.randint(0, 400))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_a_sequential_walk(spark, seed):
    rows = rows_of(seed)
    got = {tuple(r) for r in H.build_chains(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_late_rows_rebuild_only_their_chains(spark):
    rows = rows_of(9)
    base, late = [r for r in rows if r[0] == "a"] + rows[:50], [r for r in rows if r[0] == "b"]
    raw, batch = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(late, SCHEMA)
    got = {tuple(r) for r in H.rebuild_affected(H.build_chains(raw), raw, batch).collect()}
    assert got == brute(base + late)


@pytest.mark.parametrize("blocks", [1, 3, 17])
def test_a_hot_chain_is_cut_by_rows(spark, blocks):
    r = random.Random(blocks)
    rows = [("a", "p", r.choice("xyz"), r.random() < 0.7, DAY0 + timedelta(seconds=i), DAY0) for i in range(400)]
    assert {tuple(x) for x in H.build_chains(spark.createDataFrame(rows, SCHEMA), blocks).collect()} == brute(rows)


def test_edges(spark):
    t = DAY0
    rows = [("a", "p", None, True, t, t), ("a", "p", "x", True, None, t), (None, "p", "x", True, t, t), ("a", "p", "x", False, t, t), ("b", "p", "x", True, t, None), ("b", "p", "x", True, t, None)]
    got = {tuple(r) for r in H.build_chains(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("b", "p", "x", t, None)}
    assert H.build_chains(spark.createDataFrame([], SCHEMA)).count() == 0


def test_raw_changes_ignore_clashing_columns(spark):
    df = spark.createDataFrame([("u", "works_at", "  The  Lab ", "positive", DAY0, DAY0, 1, "block")], "subject string, predicate string, object string, polarity string, valid_from timestamp, recorded_at timestamp, value int, block string")
    assert [r.value for r in H.raw_changes(df, ["works_at"]).collect()] == ["the lab"]


def test_stored_history_is_replaced_atomically(spark, tmp_path):
    rows = rows_of(4, 60)
    table = H.HistoryTable(spark, f"file://{tmp_path}/h")
    table.load(spark.createDataFrame(rows[:30], SCHEMA))
    table.apply(spark.createDataFrame(rows[30:], SCHEMA))
    assert {tuple(r) for r in table.read().collect()} == brute(rows)
    before = table.manifest()
    table.apply(spark.createDataFrame([r for r in rows if r[0] == "a"][:1], SCHEMA))
    kept = {(w, b, p) for w, b, p in before if w == "chains"} & set(table.manifest())
    assert len(kept) == len({b for w, b, _ in before if w == "chains"}) - 1
    table.apply(spark.createDataFrame([], SCHEMA))
    with pytest.raises(ZeroDivisionError), table.versions.next():
        raise ZeroDivisionError
    assert {tuple(r) for r in table.read().collect()} == brute(rows)
