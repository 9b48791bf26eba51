"""Items packed into containers of a fixed capacity, with little room left.

Best-fit decreasing with conflicts: open bins are ordered by residual room and
carry a bitmap of the sources and the duplicate clusters they hold; the search
starts at the tightest bin that has room and goes on to the next larger residual
until a compatible bin is found, and a new bin is opened if there is none.

A bin holds one copy of a text, unless a shard has more copies of it than it can
have bins (then the first copies are spread over all bins and the rest is packed
as if there were no conflict, so that hot copies cost no room). Sources are far
fewer than bins hold items, so they are a preference: of the bins of one residual
one without the item's source is taken if there is any. With ``strict=True`` no
source shares a bin either.

Copies of a text are of one size, so they come in a row and each goes on where
the search for the one before stopped: a cluster costs one walk, however large.

An item larger than the capacity is cut into full pieces, which fill bins of
their own, and one rest. Other items are never split.

Scale: items are dealt by hash into shards of a bounded number, packed in
parallel; the few bins of each shard that stay notably empty are dealt again and
repacked in a second pass. No shard, and so no task, grows with the data.

Defined cases: null and empty texts have size 0 and go into a bin like any
item; equal sizes are taken in order of the key; capacities below 1 and null
capacities give no bins; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000
MOST_BUDGETS = 1000
#: bins with more than this share of room are packed again
LOOSE = 0.02
OUT = "budget_id int, bin_id string, item bigint, part int, size int, source string, cluster bigint, room int"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, strict: bool = False) -> list[int]:
    """Bin number of each item (items in the order given, best largest first; copies side by side)."""
    by_room: dict[int, dict[int, dict[int, None]]] = {}  # residual -> source bitmap -> bins in order
    rooms: list[int] = []  # residuals in use, ascending
    room_of: list[int] = []
    src_bits: list[int] = []
    held: list[set[int]] = []  # clusters of a bin
    out: list[int] = []
    copies: dict[int, int] = {}
    for c in clusters:
        copies[c] = copies.get(c, 0) + 1
    fewest = -(-sum(sizes) // capacity)

    def take_out(b: int) -> None:
        groups = by_room[room_of[b]]
        del groups[src_bits[b]][b]
        if not groups[src_bits[b]]:
            del groups[src_bits[b]]
        if not groups:
            del by_room[room_of[b]]
            rooms.pop(bisect_left(rooms, room_of[b]))

    def put(b: int, room: int) -> None:
        room_of[b] = room
        if room not in by_room:
            by_room[room] = {}
            insort(rooms, room)
        by_room[room].setdefault(src_bits[b], {})[b] = None

    def compatible(size: int, cluster: int):
        """Bins with room that don't hold the cluster, tightest first; told the source bit it asks for the next."""
        bit, k = (yield -1), bisect_left(rooms, size)
        while k < len(rooms):
            pools = {bits: (b for b in reversed(bins) if not cluster or cluster not in held[b]) for bits, bins in by_room[rooms[k]].items()}
            while pools:
                bits = next((x for x in pools if not x & bit), None)
                if bits is None and not strict:
                    bits = next(iter(pools))
                if bits is None:
                    break
                b = next(pools[bits], None)
                if b is None:
                    del pools[bits]
                else:
                    bit = yield b
            k += 1
        yield -1

    i = 0
    while i < len(sizes):
        size, cluster = sizes[i], clusters[i]
        # of one cluster no more than there are bins at least must keep apart
        j, apart = i + 1, bool(cluster) and (strict or copies[cluster] <= max(fewest, 1))
        while cluster and j < len(sizes) and clusters[j] == cluster and sizes[j] == size:
            j += 1
        search = compatible(size, cluster)
        next(search)
        chosen: list[int] = []
        for k in range(i, j):
            b = search.send(1 << sources[k])
            if b < 0:
                break
            chosen.append(b)
        for k in range(i, j):
            bit, b = 1 << sources[k], chosen[k - i] if k - i < len(chosen) else -1
            if b < 0 and not apart:  # more copies than bins: the tightest takes one more
                again = compatible(size, 0)
                next(again)
                b = again.send(bit)
            if b < 0:
                b = len(room_of)
                room_of.append(capacity)
                src_bits.append(0)
                held.append(set())
            else:
                take_out(b)
            src_bits[b] |= bit
            if cluster:
                held[b].add(cluster)
            put(b, room_of[b] - size)
            out.append(b)
        i = j
    return out


def _pack_shard(round_no: int, strict: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        budget, shard = int(key[0]), int(key[1])
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["size", "cluster", "item", "part"], ascending=[False, True, True, True], kind="stable")
        names = {s: i for i, s in enumerate(sorted(pdf["source"].fillna("").unique()))}
        bins = best_fit(pdf["size"].tolist(), [names[s] for s in pdf["source"].fillna("")], pdf["cluster"].tolist(), capacity, strict)
        out = pdf[["item", "part", "size", "source", "cluster"]].copy()
        out.insert(0, "budget_id", budget)
        out.insert(1, "bin_id", [f"{budget}-{round_no}-{shard}-{b}" for b in bins])
        used = out.groupby("bin_id")["size"].transform("sum")
        out["room"] = (capacity - used).astype("int32")
        return out[["budget_id", "bin_id", "item", "part", "size", "source", "cluster", "room"]]

    return run


def split_items(items: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces that fill a bin alone, everything else) per budget; items: item, size, source, cluster."""
    # the list of budgets is configuration; more than MOST_BUDGETS of them is an error, not a cut
    rows = budgets.where("capacity >= 1").select("budget_id", "capacity").distinct().limit(MOST_BUDGETS + 1).collect()
    if len(rows) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    each = F.array(*[F.struct(F.lit(r[0]).alias("budget_id"), F.lit(r[1]).alias("capacity")) for r in rows]) if rows else F.array().cast("array<struct<budget_id: int, capacity: int>>")
    per = items.select("*", F.explode(each).alias("b")).select("item", "size", "source", "cluster", "b.budget_id", "b.capacity")
    full = F.floor(F.col("size") / F.col("capacity")).cast("int")
    rest = (F.col("size") - full * F.col("capacity")).cast("int")
    whole = per.where(full > 0).select("budget_id", "capacity", "item", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"), F.col("capacity").alias("size"), "source", "cluster")
    left = per.where((rest > 0) | (F.col("size") == 0)).select("budget_id", "capacity", "item", full.alias("part"), rest.alias("size"), "source", "cluster")
    return whole, left


def pack(items: DataFrame, budgets: DataFrame, strict: bool = False) -> DataFrame:
    """(budget_id, bin_id, item, part, size, source, cluster, room) of every piece of every item, for every budget."""
    whole, left = split_items(items, budgets)
    n = items.count()
    full = whole.select("budget_id", F.concat_ws("-", F.col("budget_id").cast("string"), F.lit("w"), F.col("item").cast("string"), F.col("part").cast("string")).alias("bin_id"), "item", "part", F.col("size").cast("int").alias("size"), "source", "cluster", F.lit(0).alias("room"))
    first = _deal(left, max(1, -(-n // SHARD_ITEMS)), 1, strict)
    caps = F.broadcast(budgets.select("budget_id", "capacity").distinct())
    first = first.join(caps, "budget_id")
    loose = F.col("room") > F.col("capacity") * LOOSE
    # what stayed loose is little, so one shard per SHARD_ITEMS of it
    again = first.where(loose).select("budget_id", "capacity", "item", "part", "size", "source", "cluster")
    second = _deal(again, max(1, -(-n // (8 * SHARD_ITEMS))), 2, strict)
    return full.unionByName(first.where(~loose).drop("capacity")).unionByName(second)


def report(packed: DataFrame, items: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, items, lost, over, crowded) of a packing: items asked for, items or tokens missing, bins beyond the
    capacity, and bins that hold a text twice though their shard needs as many bins as it has copies of it."""
    caps = F.broadcast(budgets.where("capacity >= 1").select("budget_id", "capacity").distinct())
    asked = items.agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("tokens"))
    parts = packed.groupBy("budget_id", "item").agg(F.sum("size").alias("size")).groupBy("budget_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
    bins = packed.groupBy("budget_id", "bin_id").agg(F.sum("size").alias("size")).join(caps, "budget_id")
    full = bins.groupBy("budget_id").agg(F.count_if(F.col("size") > F.col("capacity")).alias("over"))
    # a shard of a round is packed on its own, so its bins are what copies can be kept apart in
    own = packed.withColumn("shard", F.regexp_extract("bin_id", r"^\d+-\d+-\d+", 0)).where("shard <> ''")
    least = own.groupBy("budget_id", "shard").agg(F.sum("size").alias("t")).join(caps, "budget_id").select("budget_id", "shard", F.ceil(F.col("t") / F.col("capacity")).alias("least"))
    twice = own.where("cluster <> 0").groupBy("budget_id", "shard", "cluster", "bin_id").agg(F.count(F.lit(1)).alias("k"))
    twice = twice.groupBy("budget_id", "shard", "cluster").agg(F.sum("k").alias("copies"), F.count_if(F.col("k") > 1).alias("crowded"))
    crowded = twice.join(least, ["budget_id", "shard"]).where("copies <= least").groupBy("budget_id").agg(F.sum("crowded").alias("crowded"))
    j = caps.join(F.broadcast(asked), F.lit(True)).join(parts, "budget_id", "left").join(full, "budget_id", "left").join(crowded, "budget_id", "left")
    lost = F.col("items") - F.coalesce("n", F.lit(0)) + F.coalesce("tokens", F.lit(0)) - F.coalesce("t", F.lit(0))
    return j.select("budget_id", "items", lost.cast("bigint").alias("lost"), F.coalesce("over", F.lit(0)).alias("over"), F.coalesce("crowded", F.lit(0)).cast("bigint").alias("crowded"))


def _deal(pieces: DataFrame, shards: int, round_no: int, strict: bool) -> DataFrame:
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "part", F.lit(round_no)), F.lit(shards)).cast("int"))
    return dealt.groupBy("budget_id", "shard").applyInPandas(_pack_shard(round_no, strict), OUT)
