"""Text and vector search: an inverted index as tables, BM25, document frequency, exact vector top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.session import small_enough

K1, B = 1.2, 0.75
#: fewer stored texts than this give no document-frequency weights
LEAST_CORPUS = 50
BROADCAST_ROWS = 20_000
#: arrays the tokens of a corpus are dealt to
LISTS = 4
#: query vectors scored against a block of vectors at once
BLOCK_QUERIES = 1024


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def bm25(docs: DataFrame, queries: DataFrame, key: str = "id", text: str = "text", limit: int | Column = 60, by: list[str] | None = None) -> DataFrame:
    """(query_id, key, score), best ``limit`` per query; queries: query_id, terms array<string>.

    idf is ln((N-n+.5)/(n+.5)), at least 1e-6; ties go to the smaller key. Only the
    terms asked for are counted: they are joined (broadcast when few) to the words
    before anything is grouped, and the text lengths travel with them. ``by``: columns
    of both sides that keep corpora apart (a tenant).
    """
    by = by or []
    words = docs.select(*by, key, lexical.word_list(F.col(text)).alias("w"))
    sizes = words.select(*by, key, F.size("w").alias("length"))
    asked = queries.select(*by, "query_id", F.size(F.array_distinct("terms")).alias("terms_"), F.explode(F.array_distinct("terms")).alias("term"))
    wanted = _hint(asked.select(*by, "term").distinct())
    hit = words.select(*by, key, F.size("w").alias("length"), F.explode("w").alias("term")).join(wanted, [*by, "term"]).groupBy(*by, "term", key, "length").agg(F.count(F.lit(1)).alias("tf"))
    df = hit.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    j = df.join(total, by) if by else df.join(F.broadcast(total), F.lit(True))
    idf = j.select(*by, "term", "mean", F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6)).alias("idf"))
    part = hit.join(idf, [*by, "term"])
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = part.select(*by, "term", key, weight.alias("s")).join(asked, [*by, "term"]).groupBy("query_id", "terms_", key).agg(F.sum("s").alias("score"))
    order = [F.round("score", 6).desc(), F.col(key).asc()]
    return top_k(scored, ["query_id"], order, limit).drop("terms_")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int | Column, parts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group; cut in parts first, so a large group is never in one task."""
    salted = df.withColumn("part_", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    once = salted.withColumn("r_", F.row_number().over(Window.partitionBy(*group, "part_").orderBy(*order))).where(F.col("r_") <= k).drop("r_", "part_")
    return once.withColumn("r_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("r_") <= k).drop("r_")


def idf_weights(docs: DataFrame, tokens: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """(token, df, weight): smoothed inverse document frequency, counted by substring over the texts,
    ln((N+1)/(df+1))+1; nothing for a corpus below LEAST_CORPUS or tokens that only frame a question. ``by``: columns
    of both sides that keep corpora apart (a tenant).

    One scan of the texts for all tokens: they go to the texts in ``LISTS`` arrays, each of which tests a text
    once, and what it finds is counted map-side. Any number of tokens may be asked for.
    """
    by = by or []
    wanted = tokens.select(*by, F.lower("token").alias("token")).where(lexical.weighable(F.col("token"))).distinct()
    lists = wanted.groupBy(*by, F.pmod(F.xxhash64("token"), F.lit(LISTS)).alias("l_")).agg(F.collect_list("token").alias("tokens_"))
    low = docs.select(*by, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low_"))
    met = low.join(_hint(lists.drop("l_")), by) if by else low.join(_hint(lists.drop("l_")), F.lit(True))
    found = met.select(*by, F.explode(F.filter("tokens_", lambda t: F.contains("low_", t))).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    total = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    out = wanted.join(found, [*by, "token"], "left")
    out = (out.join(total, by) if by else out.join(F.broadcast(total), F.lit(True))).where(F.col("n") >= LEAST_CORPUS)
    df = F.coalesce("df", F.lit(0))
    return out.select(*by, "token", df.cast("bigint").alias("df"), (F.log((F.col("n") + 1) / (df + 1)) + 1).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: the dot product within -1 and 1; 0 for empty, null or unequal lengths."""
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(fits, F.lit(False)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)


def grounding(similarity: Column, floor: float = 0.4, ceiling: float = 0.7) -> Column:
    """Similarity on the scale of lexical overlap: 0 up to the floor, 1 from the ceiling."""
    return F.when(similarity <= floor, 0.0).otherwise(F.least(F.lit(1.0), (similarity - floor) / (ceiling - floor)))


def vector_top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: int = 40, keep: list[str] | None = None) -> DataFrame:
    """(query_id, key, similarity): exact nearest by cosine; queries: query_id, query.

    The queries are dealt to blocks of about ``BLOCK_QUERIES``, a row each, and every batch of vectors meets a block as
    a matrix product that keeps its best ``limit`` per query before anything is exchanged. So a batch of vectors
    sends on at most ``limit`` rows a query, however many vectors there are. ``keep``: vectors of the other side with
    other values there never meet (a tenant).
    """
    keep = keep or []
    kinds = dict(vectors.dtypes)
    n = queries.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {key} {kinds[key]}, similarity double")
    blocks = queries.where(F.size("query") > 0).select(*keep, "query_id", F.transform("query", lambda x: x.cast("float")).alias("query"), F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK_QUERIES))).alias("b_"))
    blocks = blocks.groupBy(*keep, "b_").agg(F.collect_list("query_id").alias("ids_"), F.collect_list("query").alias("qs_"))
    known = vectors.where(F.size(vector) > 0).select(*keep, F.col(key), F.transform(vector, lambda x: x.cast("float")).alias("v_"))
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"keys_ array<{kinds[key]}>, vs_ array<array<float>>"
    batch = known.mapInArrow(_packed(len(keep)), schema)
    met = batch.join(_hint(blocks), keep) if keep else batch.join(_hint(blocks), F.lit(True))
    near = met.select("keys_", "vs_", "ids_", "qs_").mapInArrow(_nearest(limit), f"query_id {dict(queries.dtypes)['query_id']}, {key} {kinds[key]}, similarity double")
    return top_k(near, ["query_id"], [F.round("similarity", 6).desc(), F.col(key).asc()], limit)


def _packed(keep: int):
    """Every batch as one row (one a value of the first ``keep`` columns): list of keys, list of vectors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            groups: dict[tuple, list[int]] = {}
            if keep:
                for i, k in enumerate(zip(*(b.column(c).to_pylist() for c in range(keep)), strict=True)):
                    groups.setdefault(k, []).append(i)
            for k, at in groups.items() if keep else [((), None)]:
                part = b if at is None else b.take(pa.array(at))
                if part.num_rows:
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in (keep, keep + 1)]
                    own = [pa.array([x], b.schema.field(c).type) for c, x in enumerate(k)]
                    yield pa.RecordBatch.from_arrays([*own, *lists], [*b.schema.names[:keep], "keys_", "vs_"])

    return run


def _nearest(limit: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, keys, sims = [], [], []
            for row in range(b.num_rows):
                ks, qs = b.column(0)[row].values, b.column(2)[row].values
                vs, ws = b.column(1)[row].values, b.column(3)[row].values
                vn, qn = np.diff(vs.offsets.to_numpy()), np.diff(ws.offsets.to_numpy())
                for size in np.unique(qn):  # vectors of another length have no similarity
                    vi, qi = np.flatnonzero(vn == size), np.flatnonzero(qn == size)
                    if not len(vi):
                        continue
                    grid = lambda a, at, n=size: a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)[np.repeat(a.offsets.to_numpy()[at] - a.offsets.to_numpy()[0], n) + np.tile(np.arange(n), len(at))].reshape(len(at), n)
                    sim = np.clip(grid(ws, qi) @ grid(vs, vi).T, -1.0, 1.0)
                    # ties at the border are kept, so that the final cut may break them by key
                    if sim.shape[1] > limit:
                        least = np.round(np.partition(sim, -limit, axis=1)[:, -limit], 6) - 1e-6
                        at, best = np.nonzero(sim >= least[:, None])
                    else:
                        at, best = np.indices(sim.shape).reshape(2, -1)
                    ids.append(qs.take(pa.array(qi[at])))
                    keys.append(ks.take(pa.array(vi[best])))
                    sims.append(sim[at, best])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(keys), pa.array(np.concatenate(sims))], ["query_id", b.schema.names[0], "similarity"])

    return run
