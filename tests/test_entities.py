from datetime import datetime

from strata import registry
from tests.oracle import connect, same

E = "id string, name string, canonical_name string, entity_type string, first_seen timestamp, last_seen timestamp, mention_count bigint"

# id, name, type, day of first and last sight
ROWS = [
    # one key: spaces of every kind go at both ends, white space within is squeezed where it is ASCII
    ("a1", "Acme Works", "organization", 5), ("a2", "\u00a0Acme  Works\u3000", None, 3), ("a3", "\u2003\u00a0Acme\tWorks\r\n", "place", 4), ("a4", " \u202f ACME\fWORKS \u1680 ", "tool", 6),
    # keys of their own
    ("b1", "Acme\u00a0Works", "organization", 1), ("b2", "Acme\u000bWorks", None, 1), ("b3", "\u200bAcme Works", None, 1), ("b4", "\u0085Acme Works", None, 1), ("b5", "Acme Works \u2028", None, 1), ("b6", "\u180eAcme Works", None, 1),
    # nothing but spaces
    ("c1", "", None, 1), ("c2", "\u00a0", "place", 2), ("c3", " \t\u2009", None, 3), ("c4", None, "place", 1),
    # lower case letter by letter
    ("d1", "\u0130zmir", "place", 2), ("d2", "izmir", "city", 1), ("d3", "i\u0307zmir", None, 1),
    ("e1", "\u039f\u0394\u039f\u03a3", "place", 1), ("e2", "\u03bf\u03b4\u03bf\u03c3", "city", 2), ("e3", "\u03bf\u03b4\u03bf\u03c2", None, 3),
    # a row without a time, or without an id, comes after those that have one
    ("f1", "Oslo", "late", None), ("f2", "OSLO", "early", 9), ("g1", "Rome", "one", None), ("g0", "ROME", "none", None), (None, "Lima", "no id", 2), ("h1", "LIMA", "an id", 2),
]


def test_odd_names_and_nulls(spark, tmp_path):
    at = lambda n: n and datetime(2025, 1, n)
    rows = [(i, name, None, kind, at(n), at(n), 1) for i, name, kind, n in ROWS]
    spark.createDataFrame(rows + rows[:3], E).coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "entities.parquet")
    df = registry.queries()["entity_upserts"](spark, str(tmp_path))
    same(df, connect(str(tmp_path)), registry.oracle_sql()["entity_upserts"])
    got = {r.key: (r.mentions, r.entity_type, r.name) for r in df.collect()}
    assert got["acme works"] == (4, "place", "\u00a0Acme  Works\u3000") and got["izmir"] == (2, "city", "izmir") and got["\u03bf\u03b4\u03bf\u03c3"][0] == 2
    assert got["oslo"][1:] == ("early", "OSLO") and got["rome"][1:] == ("none", "ROME") and got["lima"][1:] == ("an id", "LIMA")
