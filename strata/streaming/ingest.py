"""Streaming extensions: idempotent session intake and windowed roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.sources.store import GraphStore


def fresh_sessions(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Sessions of a stream once each: repeats within the watermark are dropped by keyed state."""
    return stream.withWatermark("start_time", lateness).dropDuplicatesWithinWatermark(["id"])


def new_sessions(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Sessions whose id is neither known nor repeated in the batch."""
    return batch.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")


def into_store(store: GraphStore, table: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: appends what is new to a table of the store, atomically per batch, so that a
    batch that is run again after a failure changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        if table in store.tables():
            old = store.read(table)
            store.commit(appended={table: new_sessions(old, batch).select(old.columns)})
        else:
            store.commit({table: batch.dropDuplicates(["id"])})

    return sink


def start(stream: DataFrame, store: GraphStore, table: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(into_store(store, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, keys: list[str] | None = None, value: str = "value", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) windows: window_start, keys, n, total; the same on a batch and on a stream."""
    if events.isStreaming:
        events = events.withWatermark(time, lateness)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = events.groupBy(w.alias("w"), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *(keys or []), "n", "total")


def sessionised(events: DataFrame, key: str, time: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions of a key: session_start, session_end (last event plus the gap), n."""
    if events.isStreaming:
        events = events.withWatermark(time, lateness)
    g = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


