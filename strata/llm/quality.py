"""Per-document text statistics, exact per-language ranks and outlier scores, and the kinds they decide.

``statistics`` measures whole texts with built-in expressions. ``tail_table``
ranks every statistic within its language exactly: values are counted, the
counts are sorted by range partitioning, and each partition adds the offset of
those before it; so the empirical tail probabilities need no global sort in one
task and no window over a language. What is ranked is how many *readable* texts
(:func:`readable`: sentences and common words) lie at or beyond a value, so an
outlier is what readable text of its language is not, however many lists, tables
or copies the corpus holds; :data:`IDEAL` counts as one readable text more.

``scored`` turns each tail into evidence, its logarithm over the logarithm of the
smallest tail there could be (0 usual, 1 beyond all readable texts), and adds it
up: over all statistics to ``outlier_score``, over those that speak for a kind to
``list_score`` and ``table_score``. ``kinds`` decides by these scores; the
statistics themselves only name the kind.

Sizes: languages are the four known ones and a rest, shares are thousandths, so
the evidence of shares is one broadcast row a language of 1001 values a
statistic; the two lengths are joined, by broadcast only while they are small.

Defined cases: null texts and texts without visible characters have no row;
the language is the one whose common words occur most, else the given one if it
is known, else ``xx``, which is ranked within the whole corpus; lines end at CR,
LF or both; equal values share their rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.plan import hold, spread
from strata.functions.text import visible
from strata.session import cut, small_enough

# fixed values: common words by language
COMMON = {
    "en": "the and of to is it that for was in you with not from on this which by who will there what my at as are be have has when so than do could any can",
    "de": "der die das und ist nicht wir für mit von den auch ich in zu ein eine es sich aus war nur bei dem wenn aber im sie er hat noch haben zum auf wird mehr",
    "fr": "le la les des et est que pour dans nous une il elle pas un du en sur ne plus qui par avec au son ce sans était mais de je se deux",
    "es": "el la los las que no para en una se por con más de un es su lo del al esta pero hay ya desde muy sin le nos cuando yo mi hoy",
}
#: direction in which a statistic leans away from readable text: 1 high, -1 low
LEAN = {
    "symbol_ratio": 1, "end_share": -1, "common_share": -1, "marked_share": 1, "short_share": 1, "cell_share": 1, "letter_share": -1, "unique_share": -1,
    "tag_share": 1, "clash_share": 1, "marked_chars": 1, "sentence_chars": -1, "longest": 1, "mean_word": 1,
}
#: one readable text that every corpus has
IDEAL = {
    "symbol_ratio": 0.03, "end_share": 1.0, "common_share": 0.35, "marked_share": 0.0, "short_share": 0.0, "cell_share": 0.0, "letter_share": 0.95, "unique_share": 0.8,
    "tag_share": 0.0, "clash_share": 0.0, "marked_chars": 0.0, "sentence_chars": 1.0, "longest": 14.0, "mean_word": 5.0,
}
#: statistics that speak for a kind
SPEAKS = {"list": ("marked_chars", "short_share", "common_share", "end_share", "sentence_chars", "mean_word"), "table": ("cell_share", "sentence_chars", "end_share", "common_share", "symbol_ratio")}
#: statistics without a fixed number of values, and the most rows of their evidence that are broadcast
LENGTHS = ("longest", "mean_word")
SHARES = tuple(n for n in LEAN if n not in LENGTHS)
BROADCAST_ROWS = 50_000
#: stands for the whole corpus among the languages
ALL = "*"
#: least scores of a kind
LIST_PLAIN, LIST_MARKED, TABLE, JUNK = 3.3, 2.3, 2.9, 3.5

_LINE = r"(?m)^[^\n]*\S[^\n]*$"
_MARKED = r"(?m)^[ \t]*(?:[-*•–—·+◦▪‣→>☐☑✓]|\d{1,3}[.)]|\(?[a-zA-Z]\)|\(\d{1,3}\)|\[[ xX]?\])[ \t]+\S[^\n]*$"
_END = r"(?m)[.!?…][\"”»')]*[ \t]*$"
_SHORT = r"(?m)^[ \t]*(?:\S+[ \t]+){0,6}\S*[^\s.!?…][ \t]*$"
#: cells by separator: what must occur at all, and the lines that have it
_CELLS = {
    "pipe": (r"[|│]", r"(?m)^[ \t]*[|│][^\n]*[|│][ \t]*$"),
    "tab": (r"\t", r"(?m)^[^\t\n]*\t[^\n]*$"),
    "semicolon": (r";(?! )", r"(?m)^[^;\n]*;(?! )[^\n]*$"),
    "comma": (r",(?! )", r"(?m)^[^\n]*,(?! )[^\n]*$"),
    "column": (r"\S {2,}\S", r"(?m)^(?=[^\n]*\S {2,}\S)[^\n]*$"),
}
_RULE = r"(?m)^[\s|+=:─━┌┐└┘├┤┬┴┼│-]{3,}$"
_TAG = r"<[^<>\n]{1,20}>"
#: letters no language of the four puts in a row: five consonants, five vowels, one letter three times
_CLASH = r"[bcdfghjklmnpqrstvwxz]{5}|[aeiouäöü]{5}|(\p{L})\1\1"
_SENTENCE = r"(?m)^[^\n]*[.!?…][\"”»')]*[ \t]*$"


def _count(pattern: str, c: Column | None = None, needs: str | None = None) -> Column:
    n = F.regexp_count(F.col("t_") if c is None else c, F.lit(pattern))
    return n if needs is None else F.when(F.col("t_").rlike(needs), n).otherwise(0)


def _known(language: str | None = None) -> list[str]:
    return sorted({w for x in COMMON if language in (None, x) for w in COMMON[x].split()})


def _usual(language: str) -> Column:
    return F.size(F.filter("usual_", lambda w: w.isin(_known(language))))


def _share_of_chars(pattern: str) -> Column:
    return F.length(F.array_join(F.regexp_extract_all("t_", F.lit(pattern), F.lit(0)), "")).alias("n")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per text with a visible character: key, language, counts and shares rounded to thousandths."""
    t = spread(docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("given_"), F.col(text).alias("raw_")))
    t = t.select("doc_id", "given_", F.regexp_replace(F.when(visible(F.col("raw_")), F.col("raw_")), r"\r\n?", "\n").alias("t_"))
    t = hold(t, t_=F.col("t_")).where("t_ is not null").withColumn("low_", F.lower("t_"))
    t = hold(t, words_=F.filter(F.split("low_", r"\P{L}+"), lambda w: w != ""), runs_=F.split("t_", r"[\s\p{Z}]+"))
    t = hold(t, usual_=F.filter("words_", lambda w: w.isin(_known())))
    measured = t.select(
        "doc_id", "given_",
        F.array(*[F.struct(_usual(x).alias("n"), F.coalesce(F.col("given_") == x, F.lit(False)).alias("g"), F.lit(x).alias("l")) for x in COMMON]).alias("common_"),
        _count(_LINE).alias("lines"),
        F.size("words_").alias("words"),
        F.length("t_").alias("chars"),
        F.length(F.array_join("runs_", "")).alias("solid_"),
        F.length(F.array_join("words_", "")).alias("letters_"),
        F.length(F.regexp_replace("t_", r"[^\p{L}\p{N}]+", "")).alias("alnum_"),
        _count(_END).alias("ends_"),
        _count(_MARKED).alias("marked_"),
        _count(_SHORT).alias("short_"),
        F.greatest(*[_count(p, needs=needs) for needs, p in _CELLS.values()]).alias("cells_"),
        _count(_RULE).alias("rules_"),
        _count(_TAG, needs="<").alias("tags_"),
        _count(_CLASH, F.col("low_")).alias("clash_"),
        _share_of_chars(_MARKED).alias("marked_chars_"),
        _share_of_chars(_SENTENCE).alias("sentence_chars_"),
        F.size(F.array_distinct("words_")).alias("unique"),
        F.array_max(F.transform("runs_", F.length)).alias("longest_"),
    )
    best = F.array_max("common_")
    per = lambda n, d: F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(n), F.col(d)), F.lit(0.0))), 3)
    return measured.select(
        "doc_id",
        F.when(best["n"] > 0, best["l"]).otherwise(F.coalesce(F.when(F.col("given_").isin(*COMMON), F.col("given_")), F.lit("xx"))).alias("language"),
        "chars", "lines", "words",
        F.round(F.coalesce(F.try_divide(F.col("letters_"), F.col("words")), F.lit(0.0)), 1).alias("mean_word"),
        F.round(1 - F.coalesce(F.try_divide(F.col("alnum_"), F.col("solid_")), F.lit(0.0)), 3).alias("symbol_ratio"),
        per("ends_", "lines").alias("end_share"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(best["n"], F.col("words")), F.lit(0.0))), 3).alias("common_share"),
        per("marked_", "lines").alias("marked_share"),
        per("short_", "lines").alias("short_share"),
        F.round(F.least(F.lit(1.0), F.when(F.col("lines") > 1, (F.col("cells_") + F.col("rules_")) / F.col("lines")).otherwise(0.0)), 3).alias("cell_share"),
        per("letters_", "solid_").alias("letter_share"),
        "unique",
        per("unique", "words").alias("unique_share"),
        per("marked_chars_", "chars").alias("marked_chars"),
        per("sentence_chars_", "chars").alias("sentence_chars"),
        per("tags_", "words").alias("tag_share"),
        F.col("longest_").cast("double").alias("longest"),
        per("clash_", "words").alias("clash_share"),
    )


def readable() -> Column:
    """True for texts of sentences with common words: what outliers are told from."""
    c = F.col
    return (c("common_share") >= 0.2) & (c("sentence_chars") >= 0.3) & (c("cell_share") < 0.5) & (c("marked_share") < 0.5)


def tail_table(stats: DataFrame, names: tuple[str, ...], among: Column | None = None, ideal: dict[str, float] | None = None, partitions: int | None = None) -> DataFrame:
    """(language, stat, value, upto, beyond, total): of the texts ``among`` (all by default) how many lie at or
    below and at or above each value that occurs, per language and for all (:data:`ALL`), by exact ranks.

    A value that no such text has is ranked too. ``ideal`` counts as one text more in each language.
    """
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")
    long = stats.select("language", F.coalesce(among, F.lit(False)).cast("bigint").alias("n") if among is not None else F.lit(1).cast("bigint").alias("n"), values)
    if ideal:
        rows = [(x, n, float(ideal[n]), 1) for x in COMMON for n in names]
        more = stats.sparkSession.createDataFrame(rows, "language string, stat string, value double, n bigint")
    per = long.groupBy("language", "s.stat", "s.value").agg(F.sum("n").alias("n"))
    per = cut(per.unionByName(more).groupBy("language", "stat", "value").agg(F.sum("n").alias("n")) if ideal else per, "counts")
    counts = per.unionByName(per.groupBy("stat", "value").agg(F.sum("n").alias("n")).withColumn("language", F.lit(ALL)))
    p = partitions or int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    ranged = cut(counts.repartitionByRange(p, "language", "stat", "value").withColumn("part", F.spark_partition_id()), "ranks")
    group = ["language", "stat"]
    inside = F.sum("n").over(Window.partitionBy(*group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy(*group, "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*group, "part", before.alias("before"), F.sum("m").over(Window.partitionBy(*group)).alias("total"))
    ranks = ranged.select("*", inside.alias("upto")).join(offsets, [*group, "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    return ranks.select(*group, "value", "upto", (F.col("total") - F.col("upto") + F.col("n")).alias("beyond"), "total")


def _evidence(tails: DataFrame) -> DataFrame:
    """(language, stat, value, e): the tail's logarithm over that of the smallest tail, 0 to 1."""
    highs = [n for n in LEAN if LEAN[n] > 0]
    tail = (F.when(F.col("stat").isin(highs), F.col("beyond")).otherwise(F.col("upto")) + 1) / (F.col("total") + 1)
    # one text at least, so that the smallest tail is a half or less; the largest (all and one more) counts as 1
    return tails.select("language", "stat", "value", F.greatest(F.lit(0.0), F.log(tail) / -F.log(F.greatest(F.col("total"), F.lit(1)) + 1.0)).alias("e"))


def _shares(evidence: DataFrame) -> DataFrame:
    """One row a language: of each share an array of the evidence of its thousandths. 1001 values by the shares by
    the languages, whatever the corpus holds."""
    e = evidence.where(F.col("stat").isin(*SHARES)).select("language", "stat", F.round(F.col("value") * 1000).cast("int").alias("bin"), "e")
    grid = e.select("language", "stat").distinct().select("language", "stat", F.explode(F.sequence(F.lit(0), F.lit(1000))).alias("bin"))
    filled = grid.join(e, ["language", "stat", "bin"], "left").groupBy("language", "stat").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "e"))), lambda x: x["e"]).alias("a"))
    return filled.groupBy("language").agg(*[F.max(F.when(F.col("stat") == n, F.col("a"))).alias(f"a_{n}") for n in SHARES])


def scored(stats: DataFrame) -> DataFrame:
    """``stats`` with the evidence of every statistic (``e_`` and its name), ``outlier_score`` and the scores of
    the kinds; stats should be stored, since they are read twice."""
    evidence = cut(_evidence(tail_table(stats, tuple(LEAN), readable(), IDEAL)), "evidence")
    ranked = F.when(F.col("language").isin(*COMMON), F.col("language")).otherwise(ALL)
    stats = stats.withColumn("within_", ranked)
    for n in LENGTHS:
        one = evidence.where(F.col("stat") == n).select(F.col("language").alias("within_"), F.col("value").alias(n), F.col("e").alias(f"e_{n}"))
        stats = stats.join(F.broadcast(one) if small_enough(one, BROADCAST_ROWS) else one, ["within_", n])
    # bounded by construction: six languages by the thousandths of each share
    stats = stats.join(F.broadcast(_shares(evidence).withColumnRenamed("language", "within_")), "within_").drop("within_")
    for n in SHARES:
        stats = stats.withColumn(f"e_{n}", F.get(f"a_{n}", F.round(F.col(n) * 1000).cast("int")))
    total = lambda ns: F.round(reduce(lambda a, b: a + b, [F.col(f"e_{n}") for n in ns]), 6)
    stats = stats.drop(*[f"a_{n}" for n in SHARES])
    return stats.select("*", total(LEAN).alias("outlier_score"), *[total(ns).alias(f"{k}_score") for k, ns in SPEAKS.items()])


def kind_of() -> Column:
    """list, table, junk or null (prose) of a scored document: the scores decide whether it is one at all."""
    c = F.col
    several, short_words = c("lines") >= 2, c("words") >= c("lines") * 0.5
    cells = several & (c("cell_share") >= 0.75) & (c("sentence_chars") < 0.6) & (c("tag_share") < 0.16) & (c("clash_share") < 0.3) & (c("symbol_ratio") < 0.85)
    marks = several & (c("marked_share") >= 0.6) & (c("marked_chars") >= 0.6) & (c("clash_share") < 0.3) & short_words
    items = several & (c("short_share") >= 0.75) & (c("letter_share") >= 0.45) & (c("longest") < 60) & (c("clash_share") < 0.2) & short_words & (c("unique") > 3)
    strange = ((c("e_common_share") >= 0.9) & (c("common_share") < 0.1)) | (c("e_letter_share") >= 0.95) | (c("tag_share") > 0.16) | (c("clash_share") > 0.25) | (c("unique") <= 3)
    listed = (marks & (c("outlier_score") >= LIST_MARKED)) | (items & (c("list_score") >= LIST_PLAIN))
    return F.when(cells & (c("table_score") >= TABLE), "table").when(listed, "list").when(strange & (c("outlier_score") >= JUNK), "junk")


def kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that aren't prose."""
    return hold(scored(cut(statistics(docs), "statistics")), kind=kind_of()).select("doc_id", "kind").where("kind is not null")
