"""Conversations put together from message rows by keyed streaming state.

Two stateful operators follow each other in one stream, both keyed, both closed
by the event-time watermark:

1. (session, turn number), in windows of ``RESENT``: copies of a turn that were
   sent again, however often, merge in constant space (smallest id, role, range of
   the text's fingerprint).
2. (session, block of ``BLOCK`` numbers): the turns of a conversation are
   buffered until it has been silent for ``timeout`` of event time; rows that are
   late by no more than ``lateness`` still join it. What closes is validated by
   :func:`judged` before it is emitted, with the reason if it is broken.

A session that holds a third of all rows is spread over as many keys as it has
numbers, then blocks, and no state grows beyond ``BLOCK`` turns. A conversation
longer than a block, or one that went on after its timeout, arrives as several
rows; :func:`sound_turns` joins those, again through one summary row a block.

:func:`conversing` is the stream itself. :func:`replay` runs it over a stored
table: rows of a table lie in no order, so nothing is late there, and what is
still open when the source is exhausted is closed by a punctuation row that a
second run on the same checkpoint reads. A run that dies goes on from there.

Defined cases: rows with a null session belong to none; a null turn number, a
number held by two different turns, a gap, a start other than 0 or 1, an unknown
speaker, a text without visible characters, no user turn or a user turn that no
assistant turn follows make the session unsound and drop it whole. Null
timestamps count as ``unknown`` (1970 in a replay, the time of arrival in a live
stream), such outside 1970 to 2069 as the border. An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strata.functions.text import trim_all, visible
from strata.session import shared_dir

#: window within which copies of a turn merge, and silence after which a conversation is closed
RESENT, TIMEOUT = "1 day", "30 days"
#: how late a row of a live stream may be, and of a table replayed in no order
LATENESS, UNORDERED = "1 day", "36500 days"
BLOCK = 1024
_FIRST, _LAST, _PUNCTUATION = datetime(1970, 1, 1), datetime(2069, 1, 1), datetime(2200, 1, 1)
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("session_id", T.StringType()), ("turn_number", T.IntegerType()), ("timestamp", T.TimestampType()), ("speaker", T.StringType()), ("text", T.StringType()))])
EMITTED = "session_id string, block int, closed_at timestamp, fault string, entries array<struct<number: int, id: string, role: string, print: bigint>>"
# fixed values: accepted speakers
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system"}


def role_of(speaker: Column) -> Column:
    """user, assistant or system; null means user; anything else is null."""
    name = F.lower(trim_all(F.coalesce(speaker, F.lit("user"))))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), name)


def events(rows: DataFrame, unknown: Column | None = None) -> DataFrame:
    """The columns the state needs; the text itself stays behind, as a fingerprint. A turn without a known
    speaker or visible text has no role."""
    speaker, text = trim_all(F.col("speaker")), trim_all(F.col("text"))
    when = F.greatest(F.lit(_FIRST), F.least(F.lit(_LAST), F.coalesce("timestamp", unknown if unknown is not None else F.lit(_FIRST))))
    return rows.where("session_id is not null").select(
        "session_id",
        F.col("turn_number").cast("int").alias("turn_number"),
        when.alias("event_time"),
        "id",
        F.xxhash64(speaker.isNull(), speaker, text.isNull(), text).alias("print"),
        F.when(visible(F.col("text")), role_of(F.col("speaker"))).alias("role"),
    )


def conversing(happened: DataFrame, lateness: str = LATENESS, timeout: str = TIMEOUT) -> DataFrame:
    """Validated blocks of closed conversations (:data:`EMITTED`) of a stream of :func:`events`; of a batch the same."""
    if happened.isStreaming:
        happened = happened.withWatermark("event_time", lateness)
    turns = happened.groupBy("session_id", "turn_number", F.window("event_time", RESENT).alias("sent")).agg(
        F.min("id").alias("id"), F.min("role").alias("role"), F.min("print").alias("low"), F.max("print").alias("high"), (F.count("role") == F.count(F.lit(1))).alias("whole")
    )
    entry = F.struct(F.col("turn_number").alias("number"), "id", F.when(F.col("whole"), F.col("role")).alias("role"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("print"))
    block = F.coalesce(F.floor(F.col("turn_number") / BLOCK), F.lit(-1)).cast("int")
    held = turns.select("session_id", block.alias("block"), F.window_time("sent").alias("event_time"), entry.alias("entry"))
    closed = held.groupBy("session_id", "block", F.session_window("event_time", timeout).alias("open")).agg(F.collect_list("entry").alias("entries"))
    closed = closed.select("session_id", "block", F.col("open.end").alias("closed_at"), F.sort_array("entries").alias("entries"))
    return closed.select("session_id", "block", "closed_at", judged(F.col("entries"))["fault"].alias("fault"), "entries")


def judged(entries: Column) -> Column:
    """What there is to say of sorted turns: struct(fault, n, users, lo, hi, first, last). ``fault`` names what is
    broken within them (number, twice, role, gap, unanswered) or is null; ends are left to the whole session."""
    e, n = entries, F.size(entries)
    at = lambda i: F.get(e, i)
    pairs = F.zip_with(F.slice(e, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(e, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    same = lambda p: p["a"]["number"] == p["b"]["number"]
    fault = (
        F.when(F.exists(e, lambda x: x["number"].isNull()), "number")
        .when(F.exists(e, lambda x: x["print"].isNull()) | F.exists(pairs, lambda p: same(p) & (p["a"]["print"] != p["b"]["print"])), "twice")
        .when(F.exists(e, lambda x: x["role"].isNull()), "role")
        .when(F.exists(pairs, lambda p: p["b"]["number"] - p["a"]["number"] > 1), "gap")
        .when(F.exists(pairs, lambda p: ~same(p) & (p["a"]["role"] == "user") & (p["b"]["role"] != "assistant")), "unanswered")
    )
    again = F.size(F.filter(pairs, same))
    users = F.exists(e, lambda x: x["role"] == "user")
    return F.struct(
        fault.alias("fault"), (n - again).alias("n"), users.alias("users"), at(F.lit(0))["number"].alias("lo"), at(n - 1)["number"].alias("hi"), at(F.lit(0))["role"].alias("first"), at(n - 1)["role"].alias("last")
    )


def start(happened: DataFrame, root: str, lateness: str = LATENESS, timeout: str = TIMEOUT, **trigger) -> StreamingQuery:
    """The stream of :func:`conversing` into ``root``/closed with its checkpoint in ``root``/state, both on
    storage that all executors share; started again with the same root it goes on where it was."""
    spark = happened.sparkSession
    kept = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    try:
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        out = conversing(happened, lateness, timeout).writeStream.format("parquet").option("path", f"{root}/closed").option("checkpointLocation", f"{root}/state")
        return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def emitted(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EMITTED).parquet(f"{root}/closed").where("session_id <> ''")


def source(spark: SparkSession, root: str, path: str, files_per_trigger: int | None = None, unknown: Column | None = None) -> DataFrame:
    """Events of the files at ``path``, together with the punctuation of ``root`` (none until :func:`punctuate`)."""
    fs, p = _fs(spark, root)
    fs.mkdirs(p(f"{root}/punctuation"))
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a glob the path may be one file or a folder of files
    rows = events(reader.parquet(f"{path[:-1]}[{path[-1]}]"), unknown)
    mark = spark.readStream.schema(SCHEMA).parquet(f"{root}/punctuation")
    none = {"print": F.lit(0).cast("bigint"), "role": F.lit(None).cast("string")}
    return rows.unionByName(mark.select("session_id", "turn_number", F.col("timestamp").alias("event_time"), "id", *[v.alias(k) for k, v in none.items()]))


def punctuate(spark: SparkSession, root: str) -> None:
    """One row far in the future, which carries the watermark past every open conversation; its own session is ''."""
    spark.createDataFrame([(None, "", None, _PUNCTUATION, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/punctuation")


def replay(spark: SparkSession, path: str, lateness: str = UNORDERED, timeout: str = TIMEOUT, files_per_trigger: int | None = None) -> DataFrame:
    """The stream over all that lies at ``path``, then its punctuation; returns the emitted blocks."""
    root = shared_dir(spark, "conversations")
    for closing in (False, True):
        if closing:  # only now: the source is exhausted
            punctuate(spark, root)
        start(source(spark, root, path, files_per_trigger), root, lateness, timeout).awaitTermination()
    fs, p = _fs(spark, root)
    fs.delete(p(f"{root}/state"), True)
    return emitted(spark, root)


_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def batch_blocks(rows: DataFrame, timeout: str = TIMEOUT) -> DataFrame:
    """The blocks of a whole table as the stream would emit them (for tests and backfills)."""
    return conversing(events(rows), timeout=timeout)


def sound_turns(blocks: DataFrame) -> DataFrame:
    """(session_id, pos, turn_id, speaker_role) of the sessions without fault.

    Rows of one block (it went on after its timeout) are put together first; their number is that of the
    timeouts, not of the turns. Blocks of a session meet through one summary row each.
    """
    whole = blocks.groupBy("session_id", "block").agg(F.collect_list("entries").alias("rows"))
    # sorted once; a row alone is sorted already
    whole = whole.select("session_id", "block", F.when(F.size("rows") == 1, F.get("rows", F.lit(0))).otherwise(F.sort_array(F.flatten("rows"))).alias("entries"))
    whole = whole.select("session_id", "block", "entries", judged(F.col("entries")).alias("j"))
    seam = F.lead("j.first").over(Window.partitionBy("session_id").orderBy("block"))
    ends = whole.select("session_id", "block", "j.*", F.coalesce(seam, F.lit("")).alias("follows"))
    fault = F.col("fault").isNotNull() | ((F.col("last") == "user") & (F.col("follows") != "assistant"))
    sound = (
        ends.groupBy("session_id")
        .agg(F.sum("n").alias("n"), F.max(fault).alias("fault"), F.max("users").alias("users"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where("not fault and users and lo in (0, 1) and hi - lo + 1 = n")
    )
    # copies far apart in time are one turn still, known by the smaller id; sorted entries put that one first
    e = F.col("entries")
    first = F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["number"] != x["number"]))
    kept = F.transform(first, lambda x: F.struct(x["number"].alias("number"), x["id"].alias("id"), x["role"].alias("role")))
    turns = whole.where("j.fault is null").select("session_id", kept.alias("entries")).join(sound.select("session_id", "lo"), "session_id")
    out = turns.select("session_id", "lo", F.explode("entries").alias("e"))
    return out.select("session_id", (F.col("e.number") - F.col("lo")).cast("int").alias("pos"), F.col("e.id").alias("turn_id"), F.col("e.role").alias("speaker_role"))


def conversations(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Sound turns with their texts, for use after validation."""
    texts = rows.select(F.col("id").alias("turn_id"), "session_id", "text").dropDuplicates(["turn_id", "session_id"])
    return found.join(texts, ["turn_id", "session_id"])
