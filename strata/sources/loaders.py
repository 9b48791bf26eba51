"""Readers of session files and of the two public long-conversation formats, and the report sink."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import nested
from strata.operators.timestamps import resolve


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session payloads of JSON files (an object, an array or wrapped ones), one row per file: record_id, payload."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("record_id"), F.col("value").alias("payload"))


def parse_sessions(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) of payload rows. A bare string is a user turn, speakers are lower case, a missing
    turn time is the session's, the end is the last turn's time, a missing id is derived from the place."""
    s = nested.session_rows(payloads)
    s = resolve(s.withColumn("stamp", F.coalesce("timestamp", "start_time")), "stamp", "start_us", "tz")
    sid = F.coalesce("session_id", F.concat(F.lit("sess-"), F.substring(F.sha2(F.concat_ws("/", F.col("record_id").cast("string"), F.col("session_pos").cast("string")), 256), 1, 20)))
    s = s.withColumn("session_id", sid).withColumn("user_id", F.coalesce("user_id", F.lit("default"))).withColumn("session_number", F.coalesce("session_number", F.lit(0)))
    t = nested.turn_rows(s)
    keys = s.select("record_id", "session_pos", "session_id", "tz", "start_us")
    t = resolve(t.join(keys, ["record_id", "session_pos"]), "timestamp", "turn_us", "tz").withColumn("at", F.timestamp_micros(F.coalesce("turn_us", "start_us")))
    turns = t.select("session_id", F.col("turn_pos").alias("turn_number"), F.col("at").alias("timestamp"), "speaker", "text")
    ends = turns.groupBy("session_id").agg(F.max_by("timestamp", "turn_number").alias("end_time"), F.count(F.lit(1)).cast("int").alias("total_turns"))
    sessions = s.select(F.col("session_id").alias("id"), "user_id", F.timestamp_micros("start_us").alias("start_time"), "session_number", "session_summary")
    return sessions.join(ends.withColumnRenamed("session_id", "id"), "id", "left"), turns


_HAYSTACK = "array<struct<question_id: string, question: string, question_type: string, answer: string, haystack_sessions: array<array<struct<role: string, content: string, has_answer: boolean>>>, haystack_dates: array<string>, haystack_session_ids: array<string>>>"


def read_haystack(spark: SparkSession, path: str) -> DataFrame:
    """Turns of question records with parallel session arrays: sample_id, question, category, answer,
    should_abstain (id ends in _abs), session_id, session_pos, turn_pos, stamp, speaker, text, is_evidence."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _HAYSTACK)).alias("r")).select("r.*")
    z = raw.select("question_id", "question", "question_type", "answer", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates", "haystack_session_ids")).alias("session_pos", "s"))
    t = z.select("question_id", "question", "question_type", "answer", "session_pos", F.col("s.haystack_dates").alias("stamp"), F.col("s.haystack_session_ids").alias("session_id"), F.posexplode("s.haystack_sessions").alias("turn_pos", "t"))
    t = t.where(F.length(F.trim(F.coalesce("t.content", F.lit("")))) > 0)
    return t.select(F.col("question_id").alias("sample_id"), "question", F.col("question_type").alias("category"), "answer", F.endswith("question_id", F.lit("_abs")).alias("should_abstain"), "session_id", "session_pos", "turn_pos", "stamp", F.lower("t.role").alias("speaker"), F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("is_evidence"))


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of two-speaker dialogues whose sessions lie under keys session_N; the first
    speaker is the user; questions of category 5 should be abstained from."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<sample_id: string, conversation: map<string, variant>, qa: array<struct<question: string, category: int, answer: variant>>>>")).alias("r")).select("r.*")
    entries = raw.select("sample_id", F.try_variant_get(F.try_element_at("conversation", F.lit("speaker_a")), "$", "string").alias("first"), "conversation", F.explode("conversation").alias("key", "value"))
    n = F.regexp_extract("key", r"^session_(\d+)$", 1)
    sessions = entries.where(n != "").withColumn("session_pos", n.cast("int")).withColumn("stamp", F.try_variant_get(F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))), "$", "string"))
    t = sessions.select("sample_id", "first", "session_pos", "stamp", F.posexplode(F.try_variant_get("value", "$", "array<struct<speaker: string, text: string>>")).alias("turn_pos", "t"))
    turns = t.select("sample_id", "session_pos", "turn_pos", "stamp", F.when(F.col("t.speaker") == F.col("first"), "user").otherwise("assistant").alias("speaker"), F.col("t.text").alias("text"))
    qa = raw.select("sample_id", F.posexplode("qa").alias("question_pos", "q")).select("sample_id", "question_pos", "q.question", "q.category", F.col("q.answer").cast("string").alias("answer"), F.coalesce(F.col("q.category") == 5, F.lit(False)).alias("should_abstain"))
    return turns, qa


_RECORD = "struct<question_id: string, id: string, question: string, question_type: string, category: string, answer: string, answer_keywords: array<string>, forbidden_keywords: array<string>, should_abstain: boolean, expected_resolution: map<string, string>, sessions: array<variant>, haystack_sessions: array<variant>, haystack_dates: array<string>>"


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, turns) of question records of either form, told apart by their shape: parallel arrays of sessions, dates
    and ids, or fields with fallbacks (id, question, category, answer or answer_keywords, sessions of turns).

    samples: sample_id, question, category, should_abstain, answer_keywords, forbidden_keywords, evidence_texts,
    expected_resolution; turns: sample_id, session_pos, turn_pos, speaker, text, stamp.
    """
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    r = v.select(F.posexplode(listed).alias("n_", "r_")).select("n_", "r_", F.try_variant_get("r_", "$", _RECORD).alias("r"))
    r = r.select("n_", "r.*", F.try_variant_get("r_", "$.answer", "string").alias("said_"))
    text = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    sid = F.coalesce(text("question_id", "id"), F.col("n_").cast("string"))
    # parallel arrays: the sessions are lists themselves
    parallel = F.coalesce(F.schema_of_variant(F.get("haystack_sessions", F.lit(0))).startswith("ARRAY"), F.lit(False))
    r = r.withColumn("sample_id", sid).withColumn("parallel_", parallel).withColumn("sessions_", F.coalesce(F.when(F.size("haystack_sessions") > 0, F.col("haystack_sessions")), "sessions", F.array().cast("array<variant>")))
    s = r.select("sample_id", "parallel_", "haystack_dates", F.posexplode("sessions_").alias("session_pos", "s_"))
    inner = F.coalesce(F.try_variant_get("s_", "$.turns", "array<variant>"), F.try_variant_get("s_", "$", "array<variant>"))
    stamp = F.coalesce(F.get("haystack_dates", F.col("session_pos")), F.try_variant_get("s_", "$.timestamp", "string"), F.try_variant_get("s_", "$.start_time", "string"))
    t = s.select("sample_id", "session_pos", stamp.alias("stamp"), F.posexplode(inner).alias("turn_pos", "t_"))
    get = lambda p, kind="string": F.try_variant_get("t_", p, kind)
    bare = F.when(F.schema_of_variant("t_") == "STRING", get("$"))
    t = t.select("sample_id", "session_pos", "turn_pos", "stamp", F.lower(F.coalesce(get("$.speaker"), get("$.role"), F.lit("user"))).alias("speaker"), F.coalesce(bare, get("$.text"), get("$.content")).alias("text"), F.coalesce(get("$.has_answer", "boolean"), F.lit(False)).alias("is_evidence"))
    t = t.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    proof = t.where("is_evidence").groupBy("sample_id").agg(F.collect_list("text").alias("evidence_texts"))
    none = F.array().cast("array<string>")
    words = F.transform(F.coalesce("answer_keywords", F.when(text("said_").isNotNull(), F.array("said_")), none), F.lower)
    kind = F.coalesce(text("question_type", "category"), F.lit("unknown"))
    no = F.coalesce("should_abstain", F.lit(False)) | F.endswith("sample_id", F.lit("_abs")) | F.startswith(kind, F.lit("abstention"))
    samples = r.select("sample_id", F.coalesce("question", F.lit("")).alias("question"), kind.alias("category"), no.alias("should_abstain"), words.alias("answer_keywords"), F.transform(F.coalesce("forbidden_keywords", none), F.lower).alias("forbidden_keywords"), "expected_resolution")
    samples = samples.join(proof, "sample_id", "left").withColumn("evidence_texts", F.coalesce("evidence_texts", none))
    return samples, t.drop("is_evidence")


def load_dataset(spark: SparkSession, path: str | None = None, count: int = 50) -> tuple[DataFrame, DataFrame, str]:
    """(samples, turns, source): the records at ``path`` if there are any, else generated ones; source says which."""
    if path is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return *read_samples(spark, path), path
    return *samples_of(synthetic(spark, count)), "synthetic"


def samples_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, turns) of :func:`synthetic` rows."""
    none = F.array().cast("array<string>")
    samples = rows.groupBy("sample_id").agg(*[F.first(c).alias(c) for c in ("question", "category", "should_abstain", "answer", "forbidden")], F.collect_list(F.when(F.col("is_evidence"), F.col("text"))).alias("evidence_texts"))
    samples = samples.select("sample_id", "question", "category", "should_abstain", F.when(F.col("answer") != "", F.array(F.lower("answer"))).otherwise(none).alias("answer_keywords"), F.when(F.col("forbidden") != "", F.array(F.lower("forbidden"))).otherwise(none).alias("forbidden_keywords"), F.when(F.col("should_abstain"), none).otherwise(F.col("evidence_texts")).alias("evidence_texts"))
    at = F.timestamp_micros(F.lit(1735725600000000) + F.col("session_pos").cast("bigint") * 86_400_000_000)
    return samples, rows.select("sample_id", "session_pos", "turn_pos", "speaker", "text", at.alias("at"))


def synthetic(spark: SparkSession, count: int = 50, sessions: int = 30, seed: int = 7) -> DataFrame:
    """Small generated question set (driver side, a regression signal), five categories in turn: sample_id, category,
    question, answer, forbidden, should_abstain, session_pos, turn_pos, speaker, text, is_evidence. What a question asks
    for lies in one or two of the sessions, a third of the samples has a statement that misleads, the rest is filler."""
    rng = random.Random(seed)
    values = {"city": ["Berlin", "Lagos", "Tokyo", "Lisbon", "Nairobi", "Dublin", "Boston", "Seattle"], "tool": ["Python", "Rust", "Kotlin", "Go", "Scala", "Ruby"], "drink": ["coffee", "green tea", "juice", "espresso"], "sport": ["chess", "climbing", "yoga", "tennis"]}
    forms = {"city": [["I live in {}.", "I'm based in {}."], ["I moved to {}.", "I relocated to {}."]], "tool": [["I prefer {} for data work.", "I favor {} for scripts."], ["I switched to {} for data work."]], "drink": [["My favorite beverage is {}."], ["My favorite beverage is {} now."]], "sport": [["I enjoy {}.", "I love {}."], ["I started learning {}."]]}
    asks = {"single": {"city": "Where do I live?", "drink": "What is my favorite beverage?", "sport": "Which sport do I enjoy?"}, "update": {"city": "Where do I live now?", "drink": "What is my favorite beverage now?"}, "preference": {"tool": "Which language do I prefer?"}, "temporal": {"city": "Where did I live before {}?"}, "unanswerable": {"": "What is my blood type?"}}
    fillers = ["Note {}: the meeting moved by {} minutes.", "The build took {} seconds and {} steps.", "Ticket {} has {} comments.", "Chapter {} has {} pages.", "Room {} was booked for {} people."]
    kinds, rows = list(asks), []
    for i in range(count):
        kind = kinds[i % len(kinds)]
        topic = rng.choice(list(asks[kind]))
        about = topic or "city"
        a, b, c = rng.sample(values[about], 3)
        first, second = rng.choice(forms[about][0]).format(a), rng.choice(forms[about][1]).format(b)
        told = {"single": [first], "update": [first, second], "preference": [first], "temporal": [first, second], "unanswerable": [first]}[kind]
        answer = {"single": a, "update": b, "preference": a, "temporal": a, "unanswerable": ""}[kind]
        question = asks[kind][topic].format(b)
        slots = sorted(rng.sample(range(sessions), len(told) + 1))
        misled = rng.random() < 0.35
        says = dict(zip(slots, told, strict=False)) | ({slots[-1]: f"A friend of mine talked about {c} all day."} if misled else {})
        head = (f"q{i}", kind, question, answer, c if misled else "", kind == "unanswerable")
        for s in range(sessions):
            lines = [(says[s], s in slots[:-1])] if s in says else []
            lines += [(rng.choice(fillers).format(rng.randint(5, 55), rng.randint(2, 40)), False) for _ in range(rng.randint(3, 6))]
            rng.shuffle(lines)
            for n, (text, proof) in enumerate(lines):
                rows += [(*head, s, 2 * n, "user", text, proof), (*head, s, 2 * n + 1, "assistant", "Noted.", False)]
    return spark.createDataFrame(rows, "sample_id string, category string, question string, answer string, forbidden string, should_abstain boolean, session_pos int, turn_pos int, speaker string, text string, is_evidence boolean")


def write_report(report: dict, path: str) -> None:
    """A report as readable JSON."""
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    if "://" not in path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    spark = SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def empty_sessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("record_id", T.LongType()), T.StructField("payload", T.StringType())]))
