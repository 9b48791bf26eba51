"""Encoding of a whole corpus by a public byte-level BPE vocabulary.

Text is cut by the vocabulary's pattern; each piece is merged over a segment tree
that stores, for the byte positions, the leftmost pair of smallest rank. A merge
changes the pairs of its live neighbours only, so it costs three point updates of
logarithmic length, and a piece of n bytes costs O(n log n) however long it is:
there is no quadratic case and no prefix is ever taken.

The vocabulary (about 1 MB, fixed) is read once on the driver from a path that is
a parameter and broadcast; executors need no local copy. Equal pieces of a batch
are merged once through a memo that is emptied when it is full, which changes
speed only.

Defined cases: a null and an empty text have no ids (an empty array); special
token strings in a text are ordinary text; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.plan import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text for this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 200_000
#: longer pieces are not kept in the memo, so its memory is bounded
MEMO_BYTES = 64


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the leftmost pair of smallest rank is merged next."""
    n = len(piece)
    if n == 0:
        return []
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    # node value = rank * size + position, so the minimum is the leftmost best pair
    size = 1 << max(1, (n - 1).bit_length())
    none = (1 << 40) * size
    tree = [none] * (2 * size)
    end = list(range(1, n + 1))  # end of the part that starts here
    prev = list(range(-1, n - 1))  # start of the part before
    find = ranks.get
    for i in range(n - 1):
        if (r := find(piece[i : i + 2])) is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (best := tree[1]) < none:
        i = best & (size - 1)
        j = end[i]
        stop = end[j]
        end[i] = stop
        if stop < n:
            prev[stop] = i
        changes = [(j, none)]
        r = find(piece[i : end[stop]]) if stop < n else None
        changes.append((i, none if r is None else r * size + i))
        if (p := prev[i]) >= 0:
            r = find(piece[p:stop])
            changes.append((p, none if r is None else r * size + p))
        for at, value in changes:
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                m = a if a < b else b
                if tree[k] == m:
                    break
                tree[k] = m
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    import regex

    find = regex.compile(PATTERN).finditer
    memo: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for m in find(text):
            piece = m.group()
            ids = memo.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8", "surrogatepass"), ranks)
                if len(piece) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    return encode


_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def _batches(key: str, shared, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if key not in _ENCODERS:  # one per worker process, kept between tasks
            _ENCODERS.clear()
            _ENCODERS[key] = encoder(shared.value)
        encode = _ENCODERS[key]
        for batch in batches:
            rows = [encode(t) if t else [] for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, rows), np.int32, len(rows))
            if count_only:
                last, name = pa.array(sizes, pa.int32()), "tokens"
            else:
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter((x for r in rows for x in r), np.int32, int(offsets[-1]))
                last, name = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "ids"
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], last], [*others, name])

    return run


_SHARED: dict[tuple[int, str], object] = {}


def _vocabulary(spark: SparkSession, path: str):
    at = (id(spark.sparkContext), path, os.stat(path).st_mtime_ns)
    if at not in _SHARED:
        _SHARED.clear()
        _SHARED[at] = spark.sparkContext.broadcast(load_ranks(path))
    return _SHARED[at]


def _run(df: DataFrame, key: str, text: str, path: str, count_only: bool, extra: tuple[str, ...]) -> DataFrame:
    spark = df.sparkSession
    cols = spread(df.select(key, *extra, F.col(text).cast("string").alias("text")))
    kinds = dict(cols.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *extra)) + (", tokens int" if count_only else ", ids array<int>")
    return cols.mapInArrow(_batches(path, _vocabulary(spark, path), count_only), schema)


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, whole texts, no special tokens."""
    return _run(df, key, text, path, False, ())


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, *extra, tokens int) of every row."""
    return _run(df, key, text, path, True, extra)
