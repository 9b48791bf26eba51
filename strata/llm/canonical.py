"""Free-typed values mapped to a canonical list by a pigeonhole join, in SQL operators only.

A typed value becomes a few *readings* (all of it, without brackets, up to a
comma, without filler words, abbreviations written out, digits read as letters).
A reading equal to a key of the list is matched at once. The rest goes through
the pigeonhole join: a reference key is cut into k+1 segments, of which at least
one survives k edits unharmed and at most k places away; so readings and keys
meet by equality on (category, length, segment, substring) and only those pairs
are verified by ``levenshtein``. Values that meet nothing are reported by an
anti-join, as item -1.

The list has a size that is checked before it is broadcast; beyond it the same
joins shuffle. Only distinct readings are joined, and the way back to the rows
is salted, since one value may be a third of them.

Defined cases: null and blank values (nothing visible) give no row; values
without letters or digits give -1; ties go to the smaller distance, the earlier
reading, then the smaller item; an empty list maps all to -1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import fold, visible
from strata.session import cut, small_enough

BROADCAST_ROWS = 50_000
SALT = 16
# fixed values: written-out forms of common abbreviations in job titles
ABBREVIATIONS = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "assoc": "associate", "asst": "assistant", "princ": "principal", "prin": "principal",
    "plat": "platform", "mgr": "manager", "coord": "coordinator", "tech": "technician", "eng": "engineer", "engr": "engineer", "libr": "librarian", "sec": "security",
    "log": "logistics", "rsrch": "research", "res": "research", "curr": "curriculum", "cat": "catalog", "loc": "localization", "bill": "billing", "pay": "payments",
    "hw": "hardware", "strat": "strategist", "des": "designer", "anal": "analyst", "dir": "director", "dev": "developer", "admin": "administrator", "exec": "executive",
}
# fixed values: words around a name that do not belong to it, by category
FILLERS = {
    "city": r"^(?:in|near|the|from|city of|town of|downtown|central|greater|the greater|inner)\s+|\s+(?:city|town|area|region|metro|downtown|district|county)$",
    "job_title": r"^(?:a|an|the|our|as|as an?)\s+|\s+(?:contract|contractor|mentor|part time|full time|interim|freelance)$",
    "tool": r"^(?:the|our|a)\s+|\s+(?:app|cli|server|client|tool|cloud|self hosted|hosted|beta|v?\d+(?: \d+)*)$",
    "company": r"^(?:the|at)\s+|\s+(?:team|hq|gmbh|inc|ltd|llc|plc|ag|sa|s a|co|corp|limited|headquarters)$",
}
CATEGORIES = tuple(FILLERS)


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.regexp_replace(c, "[™®©]", " ")), r"[^a-z0-9]+", " "))


def _compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _strip(words: Column) -> Column:
    """Filler words off both ends, several in a row."""
    by = lambda p: reduce(lambda c, _: F.trim(F.regexp_replace(c, p, " ")), range(3), words)
    return reduce(lambda rest, kv: F.when(F.col("category") == kv[0], by(kv[1])).otherwise(rest), list(FILLERS.items()), words)


def _expand(words: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def readings(values: DataFrame) -> DataFrame:
    """(category, value, reading, cost): the ways a distinct value may be meant, cheapest first."""
    v = F.col("value")
    head = F.regexp_replace(v, r"(?i)[,;/|(\[].*$|\s+[@–—]\s.*$|\sat\s.*$", "")
    bare = F.regexp_replace(v, r"\s*[(\[][^)\]]*[)\]]", "")
    tail = F.regexp_extract(bare, r"^([^,]*),\s*([^,]+)$", 2)
    swapped = F.when(tail != "", F.concat_ws(" ", tail, F.regexp_extract(bare, r"^([^,]*),\s*([^,]+)$", 1)))
    # in steps, so that every expression is evaluated once and stays within a compiled method
    forms = values.select("category", "value", _plain(v).alias("w0"), _plain(head).alias("w1"), _plain(swapped).alias("w2"))
    forms = forms.select("category", "value", "w0", "w1", "w2", _strip(F.col("w0")).alias("w3"), _strip(F.col("w1")).alias("w4"))
    forms = forms.select("category", "value", F.array("w0", "w1", "w3", "w4", "w2").alias("w"), F.when(F.col("category") == "job_title", F.array("w3", "w4", "w2")).alias("short"))
    forms = forms.select("category", "value", F.concat("w", F.coalesce(F.transform("short", _expand), F.array().cast("array<string>"))).alias("w"))
    forms = forms.select("category", "value", F.array_distinct(F.filter(F.transform("w", _compact), lambda x: x != "")).alias("w"))
    digits = lambda one: F.transform("w", lambda x: F.translate(x, "0134578", f"o{one}eastb"))
    forms = forms.select("category", "value", F.array_distinct(F.concat("w", digits("l"), digits("i"))).alias("w"))
    return forms.select("category", "value", F.posexplode_outer("w").alias("cost", "reading")).where("reading is not null")


def reference_keys(items: DataFrame) -> DataFrame:
    """(category, key, item_id, fuzzy): names may match with edits; aliases and unambiguous company stems only as they are."""
    named = items.select("category", _compact(_plain(F.col("canonical_name"))).alias("key"), "item_id", F.lit(True).alias("fuzzy"))
    alias = items.select("category", F.explode("aliases").alias("a"), "item_id").select("category", _compact(_plain(F.col("a"))).alias("key"), "item_id", F.lit(False).alias("fuzzy"))
    stem = items.where("category = 'company'").select("category", _compact(F.regexp_replace(_plain(F.col("canonical_name")), r"\s+\S+$", "")).alias("key"), "item_id")
    stem = stem.groupBy("category", "key").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n")).where("n = 1").select("category", "key", "item_id", F.lit(False).alias("fuzzy"))
    keys = named.unionByName(alias).unionByName(stem).where("key <> ''")
    return keys.groupBy("category", "key").agg(F.max(F.struct("fuzzy", (-F.col("item_id")).alias("m"))).alias("r")).select("category", "key", (-F.col("r.m")).alias("item_id"), F.col("r.fuzzy").alias("fuzzy"))


def _segment(i: Column | int, n: Column, k: int) -> tuple[Column, Column]:
    """Start (0-based) and length of segment i of k+1 of a key of n characters."""
    start = F.floor(n * i / (k + 1)).cast("int")
    return start, F.floor(n * (i + 1) / (k + 1)).cast("int") - start


def pigeonhole_match(read: DataFrame, keys: DataFrame, k: int = 2, least: int = 6) -> DataFrame:
    """(category, value, cost, item_id, d) for readings within ``k`` edits of a fuzzy key; keys shorter than ``least`` match only exactly."""
    n = F.length("key")
    cuts = F.array(*[F.struct(F.lit(i).alias("seg"), F.substr(F.col("key"), s + 1, length).alias("piece")) for i in range(k + 1) for s, length in (_segment(i, n, k),)])
    index = keys.where(F.col("fuzzy") & (n >= least)).select("category", "key", "item_id", n.alias("n"), F.explode(cuts).alias("c")).select("category", "key", "item_id", "n", "c.seg", "c.piece")
    m = F.length("reading")
    probes = [F.struct(F.lit(dn).alias("dn"), F.lit(i).alias("i"), F.lit(t).alias("t")) for dn in range(-k, k + 1) for i in range(k + 1) for t in range(-k, k + 1)]
    cand = read.select("category", "value", "cost", "reading", F.explode(F.array(*probes)).alias("p"))
    n = m + F.col("p.dn")
    s, length = _segment(F.col("p.i"), n, k)
    cand = cand.select("category", "value", "cost", "reading", n.alias("n"), F.col("p.i").alias("seg"), (s + F.col("p.t") + 1).alias("at"), length.alias("length"))
    cand = cand.where((F.col("at") >= 1) & (F.col("length") > 0) & (F.col("at") + F.col("length") - 1 <= m) & (F.col("n") >= least))
    cand = cand.select("category", "value", "cost", "reading", "n", "seg", F.substr("reading", F.col("at"), F.col("length")).alias("piece"))
    small = small_enough(index, BROADCAST_ROWS)
    pairs = cand.join(F.broadcast(index) if small else index, ["category", "n", "seg", "piece"]).select("category", "value", "cost", "reading", "key", "item_id")
    d = F.levenshtein("reading", "key", k)
    return pairs.withColumn("d", d).where("d >= 0").select("category", "value", "cost", "item_id", "d")


def map_values(rows: DataFrame, items: DataFrame, k: int = 2) -> DataFrame:
    """``rows`` (src, rec_id, value, category; null category means any) with the ``item_id`` meant, or -1."""
    rows = rows.select("src", "rec_id", "value", "category").where(visible(F.col("value"))).distinct()
    any_of = F.when(F.col("category").isNull(), F.array(*map(F.lit, CATEGORIES))).otherwise(F.array("category"))
    # distinct values only: one value may be a third of all rows
    asked = rows.select("value", "category").distinct()
    wanted = asked.select("value", F.col("category").alias("asked"), F.explode(any_of).alias("category"))
    read = cut(readings(wanted.select("value", "category").distinct()), "readings")
    keys = reference_keys(items)
    small = small_enough(keys, BROADCAST_ROWS)
    exact = read.join((F.broadcast(keys) if small else keys).withColumnRenamed("key", "reading"), ["category", "reading"]).select("category", "value", "cost", "item_id", F.lit(0).alias("d"))
    rest = read.join(exact.select("category", "value").distinct(), ["category", "value"], "left_anti")
    hits = exact.unionByName(pigeonhole_match(rest, keys, k))
    best = hits.groupBy("category", "value").agg(F.min(F.struct("d", "cost", "item_id")).alias("b"))
    mapped = wanted.join(best, ["category", "value"]).groupBy("asked", "value").agg(F.min(F.struct("b.d", "b.cost", "b.item_id")).getField("item_id").alias("item_id"))
    mapped = cut(mapped.withColumn("asked", F.coalesce("asked", F.lit(""))), "mapped")
    all_asked = asked.select(F.coalesce("category", F.lit("")).alias("asked"), "value")
    unmatched = all_asked.join(mapped, ["asked", "value"], "left_anti").withColumn("item_id", F.lit(-1).cast("bigint"))
    # salted on the way back to the rows
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALT)]))
    right = mapped.select("asked", "value", F.col("item_id").cast("bigint").alias("item_id")).unionByName(unmatched).withColumn("salt", salts)
    left = rows.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALT)).cast("int")).withColumn("asked", F.coalesce("category", F.lit("")))
    return left.join(right, ["asked", "value", "salt"]).select("src", "rec_id", "value", "item_id")
