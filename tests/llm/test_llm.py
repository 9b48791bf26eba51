import os
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import canonical, conversations, encode, packing, pii, quality, survivors

T0 = datetime(2025, 1, 1)
TURN = "id string, session_id string, turn_number int, timestamp timestamp, speaker string, text string"


# ---- conversations -------------------------------------------------------------------------------
def turns(*rows):
    return [(f"t{i}", s, n, t, sp, tx) for i, (s, n, t, sp, tx) in enumerate(rows)]


def test_sound_and_unsound_sessions(spark, tmp_path):
    rows = turns(
        ("ok", 2, T0, "User", "b"), ("ok", 1, datetime(2030, 1, 1), " SYSTEM", "s"), ("ok", 3, None, "bot", "c"), ("ok", 3, T0, "bot ", " c"),
        ("gap", 0, T0, "user", "a"), ("gap", 2, T0, "ai", "b"),
        ("two", 0, T0, "user", "a"), ("two", 0, T0, "user", "x"), ("two", 1, T0, "ai", "b"),
        ("open", 0, T0, "user", "a"), ("blank", 0, T0, "user", " ​"), ("blank", 1, T0, "ai", "b"),
        ("who", 0, T0, "tool", "a"), ("null", None, T0, "user", "a"), (None, 0, T0, "user", "a"), ("two2", 2, T0, "user", "a"), ("two2", 3, T0, "ai", "a"),
        ("quiet", 0, T0, "ai", "a"), ("nil", 0, T0, None, "a"), ("nil", 1, T0, "AI", "b"),
    )
    df = spark.createDataFrame(rows, TURN)
    df.withColumn("block", F.lit(1)).write.parquet(f"{tmp_path}/turns")
    want = {("ok", 0, "t1", "system"), ("ok", 1, "t0", "user"), ("ok", 2, "t2", "assistant"), ("nil", 0, "t18", "user"), ("nil", 1, "t19", "assistant")}
    streamed = conversations.replay(spark, f"{tmp_path}/turns", files_per_trigger=1)
    assert {tuple(r) for r in conversations.sound_turns(streamed).collect()} == want
    assert {tuple(r) for r in conversations.sound_turns(conversations.batch_blocks(df)).collect()} == want
    faults = {r.session_id: r.fault for r in streamed.collect() if r.fault}
    assert faults == {"gap": "gap", "two": "twice", "blank": "role", "who": "role", "null": "number"}


def test_sessions_spread_over_micro_batches_stay_whole(spark, tmp_path):
    rows = [(f"{s}{n}", f"s{s}", n, datetime(2025, 1 + (5 * n + s) % 12, 3), ("user", "ai")[n % 2], f"{n}") for s in range(4) for n in range(6)]
    df = spark.createDataFrame(rows, TURN)
    for i in range(4):
        df.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
    got = conversations.sound_turns(conversations.replay(spark, f"{tmp_path}/turns", files_per_trigger=1)).collect()
    assert {(r.session_id, r.pos, r.turn_id) for r in got} == {(f"s{s}", n, f"{s}{n}") for s in range(4) for n in range(6)} and len(got) == 24


def test_late_rows_join_until_the_timeout_and_not_after(spark, tmp_path):
    day = lambda d, h=0: datetime(2025, 1, d, h)
    files = [
        [("a0", "a", 0, day(2), "user", "x"), ("d0", "d", 0, day(2), "user", "x")],
        [("b0", "b", 0, day(3), "user", "x"), ("b1", "b", 1, day(3, 1), "ai", "y")],
        [("a1", "a", 1, day(2, 3), "ai", "y")],  # late by less than two days
        [("c0", "c", 0, day(20), "user", "x")],  # carries the watermark to the 18th
        [("d1", "d", 1, day(2, 4), "ai", "y")],  # too late: d has timed out without it
        [("c1", "c", 1, day(20, 1), "ai", "y")],
    ]
    root, closed = f"{tmp_path}/root", []
    for rows in files:
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        conversations.start(conversations.source(spark, root, f"{tmp_path}/in"), root, "2 days", "3 days").awaitTermination()
        closed.append({(r.session_id, r.fault, tuple(e.id for e in r.entries)) for r in conversations.emitted(spark, root).collect()})
    timed_out = {("a", None, ("a0", "a1")), ("b", None, ("b0", "b1")), ("d", None, ("d0",))}
    assert closed[:3] == [set()] * 3 and closed[3:] == [timed_out] * 3
    conversations.punctuate(spark, root)
    conversations.start(conversations.source(spark, root, f"{tmp_path}/in"), root, "2 days", "3 days").awaitTermination()
    found = conversations.sound_turns(conversations.emitted(spark, root)).collect()
    assert {(r.session_id, r.pos, r.turn_id, r.speaker_role) for r in found} == {(s, i, f"{s}{i}", ("user", "assistant")[i]) for s in "abc" for i in range(2)}


def test_long_session_crosses_blocks(spark):
    n = 3 * conversations.BLOCK + 5
    rows = [(f"{i:06d}", "long", i, T0, "user" if i % 2 == 0 else "ai", "x") for i in range(n - n % 2)]
    assert conversations.sound_turns(conversations.batch_blocks(spark.createDataFrame(rows, TURN))).count() == len(rows)
    # a user's turn at the end of a block, and a user's after it
    edge = [(*r[:4], "user" if r[2] in (conversations.BLOCK - 1, conversations.BLOCK) else r[4], r[5]) for r in rows]
    assert conversations.sound_turns(conversations.batch_blocks(spark.createDataFrame(edge, TURN))).count() == 0
    assert conversations.sound_turns(conversations.batch_blocks(spark.createDataFrame(rows[1:], TURN))).count() == len(rows) - 1
    assert conversations.sound_turns(conversations.batch_blocks(spark.createDataFrame([], TURN))).count() == 0


# ---- canonical list ------------------------------------------------------------------------------
ITEMS = [(1, "Port Nersolport", "city", []), (2, "Senior Payments Designer", "job_title", []), (3, "Payments Designer", "job_title", []), (4, "Signuvelflow", "tool", ["s10w"]), (5, "Droeld Systems", "company", []), (6, "Droeld Works", "company", [])]
TYPED = [
    ("PortNersolport", "city", 1), ("greater port nersolport area", "city", 1), ("P0rt Ner5olport", "city", 1), ("port nesrolport, KV", "city", 1), ("Oskvinburg", "city", -1),
    ("Sr. Payments Designer", "job_title", 2), ("Designer, Senior Payments (contract)", "job_title", 2), ("payments designer at Kelqui Foods", "job_title", 3), ("second glazier", "job_title", -1),
    ("S10W", "tool", 4), ("signuvelflow-server", "tool", 4), ("the Sîgnuvelflów cli", "tool", 4), ("s10x", "tool", -1), ("droeld systems GmbH", None, 5), ("droeld", "company", -1), ("??", "city", -1), ("0", "tool", -1),
]


def test_typed_values(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, canonical_name string, category string, aliases array<string>")
    rows = [("f", str(i), v, c) for i, (v, c, _) in enumerate(TYPED)] + [("f", "x", " ", "city"), ("f", "y", None, "city"), ("f", "0", TYPED[0][0], "city")]
    df = spark.createDataFrame(rows, "src string, rec_id string, value string, category string")
    got = {r.rec_id: r.item_id for r in canonical.map_values(df, items).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(TYPED)}
    assert {r.item_id for r in canonical.map_values(df, items.limit(0)).collect()} == {-1}
    assert canonical.map_values(df.limit(0), items).count() == 0


def test_pigeonhole_finds_all_within_two_edits(spark):
    r = random.Random(5)
    keys = ["".join(r.choice("abcde") for _ in range(r.randint(6, 12))) for _ in range(60)]

    def noisy(k):
        for _ in range(2):
            i = r.randrange(len(k))
            k = r.choice([k[:i] + k[i + 1 :], k[:i] + r.choice("abcde") + k[i:], k[:i] + r.choice("abcde") + k[i + 1 :]])
        return k

    reads = sorted({noisy(r.choice(keys)) for _ in range(150)})
    kd = spark.createDataFrame([("c", k, i, True) for i, k in enumerate(keys)], "category string, key string, item_id bigint, fuzzy boolean")
    rd = spark.createDataFrame([("c", x, 0, x) for x in reads], "category string, value string, cost int, reading string")
    got = {(x.value, x.item_id) for x in canonical.pigeonhole_match(rd, kd).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {(x, i) for x in reads for i, k in enumerate(keys) if lev(x, k) <= 2}


# ---- survivors -----------------------------------------------------------------------------------
FACT = "id string, subject string, predicate string, polarity string, object string, confidence double, source_sessions array<string>, valid_from timestamp, evidence string, qualifier string, key string"


def facts_of(spark, rows):
    return spark.createDataFrame(rows, FACT).withColumn("extraction_method", F.lit("rule-based"))


def test_survivors(spark):
    rows = [
        ("b", "u", "likes", "positive", "The Tea!", 0.9, ["s1", "s1", None], None, " ", "q1", "k"), ("a", "u", "likes", "positive", "téa", 0.9, ["s2"], T0, "said", None, "k"), ("a", "u", "likes", "positive", "téa", 0.9, ["s2"], T0, "said", None, "k"),
        ("c", "u", "likes", "positive", "TEA", None, None, None, None, "q2", "k"), ("d", "u", "likes", "negative", "tea", 0.9, ["s"], T0, "x", None, "k"), ("e", None, "likes", "positive", "tea", 0.9, ["s"], T0, "x", None, "k"), ("f", "u", "likes", "positive", "!!", 0.9, ["s"], T0, "x", None, "k"), ("g", "u", "likes", "positive", "..", 0.9, ["s"], T0, "x", None, "k"),
    ]
    df = facts_of(spark, rows)
    assert [tuple(r) for r in survivors.survivors(df).collect()] == [("a", "a", "a", 3, 2)]
    assert survivors.surviving_records(df).collect()[0].qualifier in ("q1", "q2")
    assert survivors.survivors(df.limit(0)).count() == 0


def test_records_gather_the_group(spark):
    rows = [
        ("a", "u", "likes", "positive", "tea", 0.9, ["s1", "s2", "s2", None], None, " ", None, ""), ("b", "u", "likes", "positive", "Tea", 0.8, ["s2", "s3"], T0, "second", None, ""), ("b", "u", "likes", "positive", "Tea", 0.8, ["s2", "s3"], T0, "second", None, ""),
        ("c", "u", "likes", "positive", "TEA", None, None, datetime(2026, 1, 1), "third", None, ""), ("d", "u", "likes", "positive", "rye", 0.9, ["s9"], T0, "alone", None, ""), ("d", "u", "likes", "positive", "rye", 0.9, ["s9"], T0, "alone", None, ""),
    ]
    df = facts_of(spark, rows)
    got = sorted(tuple(r) for r in survivors.gathered(df).collect())
    assert got == [("a", "evidence", "second"), ("a", "evidence", "third"), *(("a", "source_sessions", s) for s in ("s1", "s2", "s3"))]
    (r,) = survivors.surviving_records(df).collect()
    assert (r.survivor_id, r.object, r.confidence, r.valid_from, r.evidence_id, r.evidence, r.n_sources) == ("a", "tea", 0.9, T0, "b", "second", 3)
    assert survivors.gathered(df.limit(0)).count() == 0


def test_currency_from_learned_order(spark):
    seen = [(f"x{i}{v}", f"u{i}", "has", "positive", "job", 0.5, None, datetime(2025, 1, 1 + 5 * n), None, v, "") for i in range(6) for n, v in enumerate(("junior", "senior"))]
    group = [("p", "z", "has", "positive", "rank", 0.5, None, None, None, "junior", ""), ("q", "z", "has", "positive", "rank", 0.5, None, None, None, "senior", ""), ("r", "z", "has", "positive", "rank", 0.5, None, None, None, "junior", "")]
    got = {r.group_id: r.value for r in survivors.latest_values(facts_of(spark, seen + group), ("qualifier",)).collect()}
    assert got["p"] == "senior"


def test_newest_dated_value_yields_only_to_the_learned_order(spark):
    def fact(i, s, at, v):
        return (i, s, "has", "positive", "job", 0.5, None, at, None, v, "")

    day = lambda n: datetime(2025, 1, n)
    steps = (("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"))
    seen = [fact(f"{v}{w}{i}{n}", f"{v}{w}{i}", day(1 + 5 * n), q) for v, w in steps for i in range(4) for n, q in enumerate((v, w))]
    groups = {
        "unordered": (day(1), "b", "m", "m", "b"), "earlier": (day(1), "c", "a", "a", "c"), "far": (day(1), "a", "c", "m", "c"),
        "cycle": (day(1), "x", "y", "z", "x"), "undated": (None, "a", "c", "a", "c"), "only": (day(1), "b", None, None, "b"),
    }
    rows = [fact(f"{g}{i}", g, at if i == 0 else None, q) for g, (at, *qs, _) in groups.items() for i, q in enumerate(qs)]
    found = survivors.latest_values(facts_of(spark, seen + rows)).where("field = 'qualifier'").collect()
    got = {r.group_id: r.value for r in found}
    assert {g: got[f"{g}0"] for g in groups} == {g: want for g, (*_, want) in groups.items()}
    how = {r.group_id[:-1]: r.decided for r in found}
    assert {g: how[g] for g in groups} == {"unordered": "date", "earlier": "date", "far": "order", "cycle": "date", "undated": "order", "only": "date"}


# ---- personal data -------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail joaquin dot ondra at labs dot example or a.b+c@x-y.co.example", ["email", "email"]),
        ("user@Solversync is a prompt, Tool@2.4.24 a package, deploy@build-04:/srv a host", []),
        ("X at Lominsol Collective dot the map, so to speak.", []),
        ("call (415) 555 0125 ext. 72 or +49 30 23125 341 or 030/23125-958", ["phone", "phone", "phone"]),
        ("Part no. 717-418-4449, ticket 4471-20-5372, invoice 03-6972-4, run id is 1747489366028, 192.0.2.42", []),
        ("My SSN 973-17-5871, NI number QQ 50 23 19 B and DNI 90205801U", ["id_number"] * 3),
        ("We moved from 475 E. Orchard Ave., Apt 11C to Calle Saltmarsh 147, 3º B on Monday", ["address", "address"]),
        ("Room 14 in Weaver Court; the street was closed; lane 17; 487 bis rue des Old Mills, Oskfalvergate; Juniperstraße 356, 05189 Hafalhaven", ["address", "address"]),
        ("Regards, Pernemans, Amara and hi, this is søren o'jolbrstrand and Dr. LEONA DE WYTHORSEN", ["person"] * 3),
        ("Rosa said hi. Ulla is here. Rosa Merovic Labs hired. freya.brelv@x.example", ["email"]),
        ("", []),
        ("plain words only", []),
    ],
)
def test_personal_data(text, kinds):
    assert sorted(k for *_, k in pii.find_spans(text)) == sorted(kinds)


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("12 Maple Circle", ["address"]), ("Sent to 4 Old Tanners Alley and 77 N. Birch Pkwy", ["address"] * 2), ("5 Kelp Dr, 6 Kelp Quay, 7 Kelp Pl, 8 Kelp Sq, 9 Kelp Hwy", ["address"] * 5),
        ("Lindensteig 4", ["address"]), ("Birkenweg\n12", ["address"]), ("S.S.N. 973 17 5871", ["id_number"]), ("NIE: X 1234567 L", ["id_number"]), ("Thanks, Señor Quillan Vance", ["person"]),
        ("write to joaquin\nat\nlabs dot example", ["email"]),
    ],
)
def test_every_word_of_a_parser_is_an_anchor(text, kinds):
    assert sorted(k for *_, k in pii.find_spans(text)) == kinds


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a Z 5 07 @ . , - ( ) [ ] + / ' é 415 0125 at dot [at] com example mailto: &#64; 12 N. b Maple Circle dr rue des weg Straße str. calle c/ nº QQ 50 23 19 B 973-17-5871 ssn NIE national id card is Driver's license".split(" "), " ", " ", "  ", "\n"]), max_size=30).map("".join))
def test_anchors_lose_nothing_of_whole_text_search(text):
    flat, p = pii._flat(text), pii._patterns()
    found = {name: [m.span() for m in ms] for name, ms in pii._matches(text, flat, pii._anchors(flat), p)}
    for name in ("cued_id", "bare_id", "phone", "address"):
        assert found.get(name, []) == [m.span() for m in p[name].finditer(text)]
    mails = found.get("email", [])
    assert all(any(a < m.end() and m.start() < b for a, b in mails) for m in p["email"].finditer(text) if pii._email_ok(m, text))


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("reach me at ana.kel@mail.example or Ada Kelmor at x.y@z.example", ["email", "person", "email"]), ("SSN 000-12-3456, SSN 666-12-3456, SSN 123-00-3456 or 123-45-0000", []), ("123-45-6789", ["id_number"]),
        ("12345678Z or 12345678A, X1234567L", ["id_number", "id_number"]), ("DNI 12345678A", ["id_number"]), ("My name is Ximena Duarte and I moved", ["person"]), ("Regards, Haruto Sato\nKelqui Foods", ["person"]),
        ("Name: Bogdan Kowalczyk | Tel", ["person"]), ("Name: Kelqui Foods | Dear Customer Service, dear New York", []), ("Dear Team Lead Kelmor Braun", []), ("Dear Port Kelmor", []),
    ],
)
def test_checks_and_introduced_names(text, kinds):
    assert [k for *_, k in pii.find_spans(text)] == kinds


@pytest.mark.parametrize("part", ["a", "a.", "a@", "1", "1 ", "x y@", "12 Maple ", "rosa ", "Rosa Merov ", "Calle a ", "ssn ", "at dot ", "my name is A", "+1 "])
def test_a_blob_takes_linear_time(part):
    import time

    def took(n):
        text = part * (n // len(part)) + " @ b"
        t = time.process_time()
        pii.find_spans(text)
        return time.process_time() - t

    took(1000)
    assert took(80_000) < 16 * max(took(20_000), 0.05)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aR5@.- (),'é Ulla​+0st"), max_size=80))
def test_spans_are_ordered_and_within(text):
    spans = pii.find_spans(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_redaction_table(spark):
    df = spark.createDataFrame([("1", "Write to a@b.example, Rosa Merov."), ("2", None), ("3", ""), ("4", "word " * 20_000 + "a@b.example")], "rec string, text string")
    got = {r.rec: r.text for r in pii.redact(df, ["rec"]).collect()}
    assert got["1"] == "Write to [EMAIL], [PERSON]." and got["2"] is None and got["3"] == "" and got["4"].endswith("word [EMAIL]")
    rows = pii.spans(df, ["rec"]).collect()
    assert {(r.rec, r.kind, r.span_no) for r in rows} == {("1", "email", 1), ("1", "person", 1), ("4", "email", 1)}


# ---- tokens and packing --------------------------------------------------------------------------
needs_files = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ranks():
    return encode.load_ranks()


@needs_files
@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=200))
def test_ids_equal_the_library(ranks, text):
    import tiktoken

    global _ENC
    _ENC = globals().get("_ENC") or tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    assert encode.encoder(ranks)(text) == _ENC.encode_ordinary(text)


@needs_files
def test_long_pieces_and_nulls(spark, ranks):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    texts = [None, "", "a" * 30_000, "".join(r.choice("ab") for _ in range(20_000)), "<|endoftext|> x", "🎉é" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {x.doc_id: x.ids for x in encode.encode_ids(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_packing(spark):
    r = random.Random(1)
    items = [(i, r.choice([0, 5, 30, 60, 100, 250]), r.choice(["a", "b", None]), r.randint(0, 400)) for i in range(900)]
    df = spark.createDataFrame(items, "item bigint, size int, source string, cluster bigint")
    budgets = spark.createDataFrame([(1, 100), (2, 64), (3, 0), (4, None)], "budget_id int, capacity int")
    rows = packing.pack(df, budgets).collect()
    for budget, cap in ((1, 100), (2, 64)):
        own = [x for x in rows if x.budget_id == budget]
        fill, parts = {}, {}
        for x in own:
            fill[x.bin_id] = fill.get(x.bin_id, 0) + x.size
            parts.setdefault(x.item, []).append(x.size)
        assert max(fill.values()) <= cap and {i: sum(p) for i, p in parts.items()} == {i: s for i, s, *_ in items}
        assert all(len(parts[i]) == max(1, -(-s // cap)) for i, s, *_ in items)
        least = -(-sum(s for _, s, *_ in items) // cap)
        assert len(fill) <= 1.25 * least + 2
    assert {x.budget_id for x in rows} == {1, 2}
    told = packing.report(packing.pack(df, budgets), df, budgets).collect()
    assert {(x.budget_id, x.items, x.lost, x.over, x.crowded) for x in told} == {(1, 900, 0, 0, 0), (2, 900, 0, 0, 0)}
    assert packing.pack(df.limit(0), budgets).count() == 0


def test_best_fit_prefers_compatible_bins():
    assert packing.best_fit([60, 50, 40, 40], [0, 1, 0, 2], [7, 8, 7, 9], 100) == [0, 1, 1, 0]
    # two copies and room for one bin: they share it; two bins of other items: one copy each
    assert packing.best_fit([50, 50], [0, 0], [7, 7], 100) == [0, 0]
    assert packing.best_fit([50, 50], [0, 0], [7, 7], 100, strict=True) == [0, 1]
    assert packing.best_fit([90, 80, 10, 10], [0, 0, 0, 0], [0, 0, 7, 7], 100) == [0, 1, 0, 1]
    # more copies than bins: spread over the bins first
    assert packing.best_fit([90, 70, 10, 10, 10], [0, 0, 0, 0, 0], [0, 0, 7, 7, 7], 100) == [0, 1, 0, 1, 1]


@pytest.mark.parametrize("cluster", [0, 7])
def test_a_hot_cluster_costs_one_walk(cluster):
    import time

    def took(n):
        t = time.process_time()
        packing.best_fit([60] * n + [5] * n, [0] * (2 * n), [0] * n + [cluster] * n, 100)
        return time.process_time() - t

    took(100)
    assert took(16_000) < 12 * max(took(4_000), 0.02)


def test_a_bin_without_the_source_is_found_however_far():
    # 1 bin of source 1, then 40 bins of source 0 with the same room: an item of source 0 belongs in the first
    got = packing.best_fit([60] * 41 + [40], [1] + [0] * 41, [0] * 42, 100)
    assert got == [*range(41), 0]
    assert packing.best_fit([50, 40, 10], [0, 0, 1], [0, 0, 0], 100, strict=True) == [0, 1, 0]


# ---- quality -------------------------------------------------------------------------------------
DOCS = {
    1: ("We paused the import this morning and nothing else changed. It was slow, so we left it.", None),
    2: ("Things to remember:\n- oat latte\n- no rye\n- ask about chess\n- 41 open conflicts\n- walnut cake", "list"),
    3: ("Oxwesville\noat latte\nkite repair\nMinbelox Partners\nrye bread\nrowing", "list"),
    4: ("| a | b |\n|---|---|\n| 1 | tea |\n| 2 | rye |", "table"),
    5: ("day;score;tool\n2025-01-01;0.5;Oxkel\n2025-01-02;0.7;Vintul", "table"),
    6: ("memory memory memory memory memory memory memory memory", "junk"),
    7: ("....................................", "junk"),
    8: ("dgwwm lbrblljth gxnjcd jjmqk lvwzbv gfnxqgw qqkk hndbphn jnk", "junk"),
    9: ("A: Where do you live?\nB: I live in the old town.\nA: Is it far from here?", None),
    10: ("über größere fenster wird die zusammenfassung leider ungenau und wir haben das nicht mehr", None),
    11: (None, None),
    12: ("​ \n", None),
    13: ("Enjoy the plum juice!", None),
}


def test_kinds(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "xx", 1) for i, (t, _) in DOCS.items()], "doc_id bigint, text string, lang string, words int")
    assert {r.doc_id: r.kind for r in quality.kinds(df).collect()} == {i: k for i, (_, k) in DOCS.items() if k}
    assert quality.kinds(df.limit(0)).count() == 0


def test_kinds_of_a_corpus_of_copies(spark):
    rows = [(i, DOCS[3 if i < 60 else 9][0], "en") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {(r.doc_id, r.kind) for r in quality.kinds(df).collect()} == {(i, "list") for i in range(60)}


def test_scores_decide(spark):
    df = spark.createDataFrame([(i, t, "en") for i, (t, _) in DOCS.items()], "doc_id bigint, text string, lang string")
    scored = quality.scored(quality.statistics(df)).cache()
    kinds = lambda d: {r.doc_id: r.kind for r in d.withColumn("kind", quality.kind_of()).where("kind is not null").collect()}
    assert kinds(scored) == {i: k for i, (_, k) in DOCS.items() if k}
    assert kinds(scored.withColumns({c: F.lit(0.0) for c in ("outlier_score", "list_score", "table_score")})) == {}


def test_lengths_are_whole(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a" * 1500, "en"), (2, "b" * 2500, "en"), (3, "the tea", "en")], "doc_id bigint, text string, lang string")
    want = {1: (1500.0, 1500.0, 1.0), 2: (2500.0, 2500.0, 1.0), 3: (3.0, 3.0, 0.0)}
    for most in (quality.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        got = {r.doc_id: (r.longest, r.mean_word, r.e_longest) for r in quality.scored(quality.statistics(df)).collect()}
        assert got == want


def test_ranks_are_exact(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["en", "de"]), round(r.choice([0.0, 0.25, r.random()]), 3), r.random() < 0.6) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id int, language string, x double, ok boolean")
    got = {(t.language, t.value): (t.upto, t.beyond, t.total) for t in quality.tail_table(df, ("x",), F.col("ok"), partitions=7).collect()}
    for lang in ("en", "de", quality.ALL):
        every = {x for _, k, x, _ in rows if lang in (k, quality.ALL)}
        vals = [x for _, k, x, ok in rows if ok and lang in (k, quality.ALL)]
        assert {v: got[lang, v] for v in every} == {v: (sum(x <= v for x in vals), sum(x >= v for x in vals), len(vals)) for v in every}
    assert len(got) == sum(len({x for _, k, x, _ in rows if lang in (k, quality.ALL)}) for lang in ("en", "de", quality.ALL))
