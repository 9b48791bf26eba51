"""Places where other systems plug in: an embedder, a language model, an external text index. All are optional
callables; without them, or where they fail, the engine goes on with what it has itself.
"""



from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import lexical

#: tokens of one request to an external index
CHUNK_TOKENS = 800
MODEL_CONFIDENCE = 0.75
_REPLY = "array<struct<predicate: string, object: string, qualifier: string, polarity: string>>"


def embedded(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None, text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with unit vectors of a text column, four decimals; an empty vector for blank texts, without an embedder or where it fails."""
    if embedder is None:
        return df.withColumn(out, F.array().cast("array<float>"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            try:
                vectors = embedder(texts)
            except Exception:  # noqa: BLE001 - a failing embedder must not stop the job
                vectors = [[] for _ in texts]
            yield pd.Series([_unit(v) if t.strip() else [] for t, v in zip(texts, vectors, strict=True)])

    return df.withColumn(out, F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text)))


def _unit(v: list[float]) -> list[float]:
    norm = sum(float(x) ** 2 for x in v) ** 0.5
    return [round(float(x) / norm, 4) for x in v] if norm else []


def salvaged(reply: Column) -> Column:
    """The JSON of a model's reply: all of it, else the first object or list in it, else null."""
    whole = F.try_parse_json(F.trim(reply))
    inner = F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")))
    return F.coalesce(whole, inner)


def modelled(rules: Callable[..., DataFrame], model: Callable[[list[str]], list[str]] | None) -> Callable[..., DataFrame]:
    """An extractor of the rules' rows and a model's. ``model`` maps texts to replies, JSON lists of predicate, object,
    qualifier and polarity; of a fact that both state the model's row counts, and a model that fails leaves the rules'."""
    if model is None:
        return rules

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield pd.Series(model([t or "" for t in batch]))
            except Exception:  # noqa: BLE001 - the rules stand alone then
                yield pd.Series([""] * len(batch))

    ask = F.pandas_udf(run, T.StringType())

    def both(df: DataFrame, keys: list[str], text: str = "text", speaker: str = "speaker") -> DataFrame:
        own = rules(df, keys, text, speaker).withColumn("by_", F.lit(0))
        asked = df.where(F.lower(F.trim(speaker)) == "user").select(*keys, F.col(text).alias("evidence_"), ask(F.col(text)).alias("reply_"))
        told = asked.select(*keys, "evidence_", F.posexplode(F.try_variant_get(salvaged(F.col("reply_")), "$", _REPLY)).alias("n_", "f_"))
        told = told.where("f_.predicate is not null and f_.object is not null").select(
            *keys, F.lit("fact").alias("kind"), F.lit(None).cast("string").alias("canonical_name"), F.lit(None).cast("string").alias("entity_type"), "f_.predicate", lexical.canonical_name(F.col("f_.object")).alias("object"),
            F.coalesce("f_.qualifier", F.lit("")).alias("qualifier"), F.coalesce("f_.polarity", F.lit("positive")).alias("polarity"), lexical.cue_of(F.col("evidence_")).alias("cue"), F.substring("evidence_", 1, 400).alias("evidence"),
            (F.col("n_") + (1 << 40)).cast("bigint").alias("seq"), F.lit(1).alias("by_"),
        )
        rows = own.unionByName(told)
        # entities and facts by their name, the model's last
        same = [*keys, "kind", F.coalesce("canonical_name", F.lit("")).alias("a_"), F.coalesce("predicate", F.lit("")).alias("b_"), F.coalesce("object", F.lit("")).alias("c_")]
        rest = [c for c in own.columns if c not in (*keys, "by_")]
        last = rows.groupBy(*same).agg(F.max_by(F.struct(*rest), F.struct("by_", "seq")).alias("r_"))
        return last.select(*keys, "r_.*")

    return both


def chunks(records: Iterable[dict], budget: int = CHUNK_TOKENS) -> Iterator[list[dict]]:
    """Consecutive records in lists of at most ``budget`` tokens; a larger record is alone in its list."""
    held, used = [], 0
    for r in records:
        cost = max(len(r["text"]) // 4, len(r["text"].split()))
        if held and used + cost > budget:
            yield held
            held, used = [], 0
        held.append(r)
        used += cost
    if held:
        yield held


def mirror(said: DataFrame, send: Callable[[list[dict]], int]) -> int:
    """Sends utterances (id, text, session_id, timestamp, speaker) to an external index, chunk by chunk in every task;
    blank texts are left out, a chunk that fails is skipped. Returns how many were written."""

    def run(rows: Iterator) -> Iterator[tuple[int]]:
        n = 0
        for chunk in chunks(r.asDict() for r in rows):
            try:
                n += send(chunk)
            except Exception:  # noqa: BLE001 - the store is the truth, the index only a copy
                continue
        yield (n,)

    rows = said.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("id", "text", "session_id", "timestamp", "speaker")
    return rows.rdd.mapPartitions(run).map(lambda x: x[0]).sum()


def hydrated(hits: DataFrame, said: DataFrame) -> DataFrame:
    """Hits of an external index (query_id, id, score) with the stored utterance; ids that aren't stored are dropped."""
    return hits.select("query_id", "id", "score").join(said.drop("score"), "id")


def describe(embedder: object | None, model: object | None, index: object | None) -> dict[str, str]:
    """What is plugged in."""
    state = lambda x: "off" if x is None else "on"
    return {"embedder": state(embedder), "model": state(model), "index": state(index), "extractor": "rules" if model is None else "rules and model"}
