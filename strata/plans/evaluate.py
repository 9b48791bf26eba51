"""Evaluation: budgeted retrievers, grading, metrics, strata and their quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import lexical
from strata.operators import budget


def document_frequency(turns: DataFrame, sample: str = "sample_id", text: str = "text") -> DataFrame:
    """(sample_id, term, df): turns of a sample that hold a term."""
    return turns.select(sample, F.explode(F.array_distinct(lexical.plain_words(F.col(text)))).alias("term")).groupBy(sample, "term").agg(F.count(F.lit(1)).alias("df"))


def lexical_scores(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """(sample_id, pos, score): shared terms by ln(N/(1+df)), over the root of the turn's length.

    turns: sample_id, pos, text; questions: sample_id, question. Terms of the question
    restrict the postings before they are counted.
    """
    asked = questions.select("sample_id", F.explode(F.array_distinct(lexical.plain_words(F.col("question")))).alias("term"))
    words = turns.select("sample_id", "pos", lexical.plain_words(F.col("text")).alias("w"))
    terms = words.select("sample_id", "pos", F.size("w").alias("n"), F.explode(F.array_distinct("w")).alias("term")).join(asked, ["sample_id", "term"])
    df = terms.groupBy("sample_id", "term").agg(F.count(F.lit(1)).alias("df"))
    total = turns.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))
    part = terms.join(df, ["sample_id", "term"]).join(total, "sample_id")
    return part.groupBy("sample_id", "pos").agg(F.round(F.sum(F.log(F.col("total") / (1 + F.col("df"))) / F.sqrt("n")), 6).alias("score"))


def contenders(ranked: DataFrame, budget_tokens: int) -> DataFrame:
    """The rows that decide a greedy fill: of a sample and cost c the first budget // c in rank order.

    Once a cost doesn't fit it never fits again, so what is kept of a cost is always its first rows, and no more
    than the budget has room for. A sample keeps at most budget * (ln(budget) + 1) rows that cost anything,
    however long it is, and one for all that cost more than the budget; rows without cost all stay.
    """
    cost = F.least(F.col("cost").cast("bigint"), F.lit(budget_tokens + 1))
    free = F.when(F.col("cost") < 1, F.col("pos"))
    nth = F.row_number().over(Window.partitionBy("sample_id", "class_", "free_").orderBy("rank", "pos"))
    rows = ranked.withColumn("class_", cost).withColumn("free_", free).withColumn("nth_", nth)
    # the first bound is a constant, so that partitions are cut before they are shuffled
    return rows.where((F.col("nth_") <= max(budget_tokens, 1)) & ((F.col("nth_") == 1) | (F.col("nth_") * F.col("class_") <= budget_tokens))).select(ranked.columns)


def fill(ranked: DataFrame, budget_tokens: int) -> DataFrame:
    """(sample_id, kept array<pos>): turns in rank order while they fit, those that don't being skipped.
    ranked: sample_id, rank, pos, cost; a sample may be of any length."""
    lists = contenders(ranked, budget_tokens).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "cost"))).alias("l"))
    kept = budget.greedy(F.transform("l", lambda x: x["cost"].cast("bigint")), budget_tokens)
    return lists.select("sample_id", F.transform(kept, lambda i: F.get("l", i)["pos"]).alias("kept"))


def strata_quotas(samples: DataFrame, limit: int) -> DataFrame:
    """(category, abstain, n, quota): largest remainders share out ``limit``; ties by the stratum's order."""
    g = samples.groupBy("category", "abstain").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    q = g.join(F.broadcast(total), F.lit(True)).withColumn("exact", F.col("n") * limit / F.col("total")).withColumn("base", F.floor("exact").cast("bigint"))
    spare = F.lit(limit) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy((F.col("exact") - F.col("base")).desc(), "category", "abstain"))
    return q.select("category", "abstain", "n", F.least(F.col("n"), F.col("base") + F.when(rank <= spare, 1).otherwise(0)).alias("quota"))


def stratified(samples: DataFrame, limit: int, seed: int = 11) -> DataFrame:
    """Samples drawn to the quotas by a hash of id and seed, so a rerun draws the same."""
    quotas = strata_quotas(samples, limit)
    w = Window.partitionBy("category", "abstain").orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id")
    return samples.withColumn("r", F.row_number().over(w)).join(F.broadcast(quotas), ["category", "abstain"]).where(F.col("r") <= F.col("quota")).select(samples.columns)


def overlaps(evidence: Column, context: Column, span: int = 60, least: int = 30) -> Column:
    """True if the context holds the first ``span`` characters of a sentence (of ``least`` at least) or of the whole text."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    ctx = flat(context)
    heads = F.transform(lexical.sentences(evidence), lambda s: F.substring(flat(s), 1, span))
    whole = F.substring(flat(evidence), 1, span)
    return F.exists(heads, lambda h: (F.length(h) >= least) & F.contains(ctx, h)) | ((whole != "") & F.contains(ctx, whole))


def correct(answer: Column, abstained: Column, required: Column, forbidden: Column, should_abstain: Column) -> Column:
    """An answer is right if it abstains where it should, else holds every required and no forbidden word."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    words = F.forall(required, lambda k: F.contains(low, F.lower(k))) & ~F.exists(forbidden, lambda k: F.contains(low, F.lower(k)))
    return F.when(should_abstain, abstained).otherwise(~abstained & words)


def metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, abstention precision, recall and F1, context recall, tokens and latency; null where nothing counts.

    results: correct, abstained, should_abstain, context_hit (null: not graded), context_tokens, latency_ms.
    """
    both = F.count_if(F.col("abstained") & F.col("should_abstain"))
    p, r = F.try_divide(both, F.count_if("abstained")), F.try_divide(both, F.count_if("should_abstain"))
    ratio = lambda c: F.round(c, 6)
    return (results.groupBy(*by) if by else results.groupBy()).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"),
        ratio(p).alias("abstain_precision"),
        ratio(r).alias("abstain_recall"),
        ratio(F.try_divide(2 * p * r, p + r)).alias("abstain_f1"),
        ratio(F.try_divide(F.count_if("context_hit"), F.count("context_hit"))).alias("context_recall"),
        ratio(F.try_divide(F.count_if(F.col("context_hit") & ~F.col("abstained")), F.count_if(F.col("context_hit").isNotNull() & ~F.col("abstained")))).alias("recall_attempted"),
        ratio(F.avg("context_tokens")).alias("mean_tokens"),
        ratio(F.avg("latency_ms")).alias("mean_latency"),
        ratio(F.percentile("latency_ms", F.lit(0.5))).alias("median_latency"),
        F.max("latency_ms").alias("max_latency"),
    )


# ---- retrievers, grading, runs -------------------------------------------------------------------
#: layers that may be read and whether a consolidation runs
CONFIGS: dict[str, tuple[set[str] | None, bool]] = {"episodic-only": ({"episodic"}, True), "semantic-only": ({"semantic"}, True), "no-consolidation": (None, False), "full": (None, True)}
BASELINES = ("full-context", "recency", "lexical-topk")


def said_turns(turns: DataFrame) -> DataFrame:
    """(sample_id, pos, text, cost): the turns with a text, numbered by session and turn within their sample.

    Positions are two numbers in one, so no sample is ever sorted in one task."""
    text = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    pos = F.col("session_pos").cast("bigint") * (1 << 20) + F.col("turn_pos")
    return text.select("sample_id", pos.alias("pos"), "text", lexical.estimated_tokens(F.col("text")).alias("cost"))


def _joined(ranked: DataFrame) -> DataFrame:
    """(sample_id, context) of texts in the order of ``rank``."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "text"))), lambda x: x["text"])
    return ranked.groupBy("sample_id").agg(F.array_join(lines, "\n").alias("context"))


def retrieve(name: str, turns: DataFrame, questions: DataFrame, budget_tokens: int = 600) -> DataFrame:
    """(sample_id, context) by a baseline: everything, the newest turns that fit, or the best by shared words that fit.
    turns of :func:`said_turns`; a sample without a hit has no row."""
    if name not in BASELINES:
        raise ValueError(f"unknown baseline {name!r}")
    if name == "full-context":  # by definition all of a sample in one text
        return _joined(turns.withColumn("rank", F.col("pos")))
    if name == "recency":
        ranked = turns.withColumn("rank", -F.col("pos"))
    else:
        scores = lexical_scores(turns, questions)
        ranked = turns.join(scores, ["sample_id", "pos"]).withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p")))
    kept = fill(ranked.select("sample_id", "rank", "pos", "cost"), budget_tokens).select("sample_id", F.posexplode("kept").alias("rank", "pos"))
    return _joined(kept.join(turns.select("sample_id", "pos", "text"), ["sample_id", "pos"]))


def context_hit(context: Column) -> Column:
    """Whether a context holds the evidence of its sample, else all its keywords; null where it should be abstained
    from or nothing can be graded."""
    low = F.lower(F.coalesce(context, F.lit("")))
    by_text = F.exists("evidence_texts", lambda e: overlaps(e, low))
    words = F.forall("answer_keywords", lambda k: F.contains(low, F.lower(k)))
    return F.when(F.col("should_abstain"), F.lit(None)).when(F.size("evidence_texts") > 0, by_text).when(F.size("answer_keywords") > 0, words)


def graded(contexts: DataFrame, samples: DataFrame) -> DataFrame:
    """Results under a reader that answers right whenever the evidence is there and refuses when it is told to.
    contexts: sample_id, context, abstained, context_tokens, latency_ms; samples: sample_id, category, should_abstain,
    answer_keywords, forbidden_keywords, evidence_texts."""
    j = samples.join(contexts, "sample_id", "left").withColumn("abstained", F.coalesce("abstained", F.lit(False)))
    j = j.withColumn("context_hit", context_hit(F.col("context")))
    low = F.lower(F.coalesce("context", F.lit("")))
    available = F.when(~F.col("should_abstain") & F.col("context_hit").isNotNull(), F.col("context_hit") & ~F.col("abstained"))
    distractor = F.when(F.size("forbidden_keywords") > 0, F.exists("forbidden_keywords", lambda k: F.contains(low, F.lower(k))))
    correct_ = F.when(F.col("should_abstain"), F.col("abstained")).otherwise(F.coalesce(available, F.lit(False)))
    return j.select("sample_id", "category", "should_abstain", "abstained", "context_hit", correct_.alias("correct"), available.alias("answer_available"), distractor.alias("distractor_present"), F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"))


def baseline(name: str, turns: DataFrame, samples: DataFrame, budget_tokens: int = 600) -> DataFrame:
    """Graded results of a baseline, which never refuses."""
    told = retrieve(name, said_turns(turns), samples.select("sample_id", "question"), budget_tokens)
    return graded(told.select("sample_id", "context", F.lit(False).alias("abstained"), lexical.estimated_tokens(F.col("context")).alias("context_tokens"), F.lit(0).alias("latency_ms")), samples)


def baseline_metrics(results: DataFrame) -> DataFrame:
    """Recall, recall of what was attempted, accuracy, share of unanswerable ones refused, of distractors, and tokens."""
    hit, tried = F.col("context_hit"), ~F.col("abstained")
    ratio = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    return results.agg(
        F.count(F.lit(1)).alias("n"), ratio(hit, hit.isNotNull()).alias("recall"), ratio(hit & tried, hit.isNotNull() & tried).alias("recall_attempted"), ratio(F.col("correct"), F.lit(True)).alias("accuracy"),
        ratio(F.col("should_abstain") & F.col("abstained"), F.col("should_abstain")).alias("unanswerable"), ratio(F.col("distractor_present"), F.col("distractor_present").isNotNull()).alias("distractor_rate"),
        F.count_if(~tried).alias("refusals"), F.round(F.avg("context_tokens"), 6).alias("mean_tokens"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"),
    )


def resolution_scores(expected: DataFrame, conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """(sample_id, expected, correct) of resolved conflicts: expected (sample_id, predicate, object) counts as right if a
    conflict of that predicate was resolved to a fact of that object. conflicts: sample_id, predicate, winner_id."""
    won = conflicts.join(facts.select(F.col("id").alias("winner_id"), F.col("object").alias("won_")), "winner_id")
    hit = expected.join(won.select("sample_id", "predicate", F.col("won_").alias("object")).distinct(), ["sample_id", "predicate", "object"], "left_semi").withColumn("hit_", F.lit(True))
    j = expected.distinct().join(hit.distinct(), ["sample_id", "predicate", "object"], "left")
    return j.groupBy("sample_id").agg(F.count(F.lit(1)).alias("expected"), F.count("hit_").alias("correct"))


def run(samples: DataFrame, turns: DataFrame, config: str = "full", policy: str = "recency", now: Column | None = None) -> DataFrame:
    """Results of the engine on all samples at once, every sample a tenant with a memory of its own: sample_id, category,
    answer, correct, abstained, should_abstain, path, query_type, context_tokens, haystack_tokens, context_hit, reader_correct,
    answer_available, distractor_present, latency_ms (of the whole run, shared out), conflicts_expected, conflicts_correct.

    turns: sample_id, session_pos, turn_pos, speaker, text, at (start of the session).
    """
    import time

    from strata.plans import intake
    from strata.plans.answer import Memory, answer
    from strata.session import cut

    layers, consolidate = CONFIGS[config]
    started = time.perf_counter()
    sid = F.concat_ws("/", "sample_id", F.col("session_pos").cast("string"))
    t = turns.select(F.col("sample_id").alias("tenant"), sid.alias("session_id"), F.col("turn_pos").alias("turn_number"), "speaker", "text", "at", "session_pos")
    s = t.groupBy("tenant", F.col("session_id").alias("id")).agg(F.min("at").alias("start_time"), F.min("session_pos").alias("session_number"))
    state, _ = intake.intake(s, t)
    if consolidate:
        state, _ = intake.sleep(state, policy, now)
    q = samples.select(F.col("sample_id").alias("query_id"), F.col("sample_id").alias("tenant"), "question")
    a = cut(answer(q, Memory.of(state), restrict_layers=layers), "answers").withColumnRenamed("query_id", "sample_id")
    n = max(1, a.count())
    spent = int((time.perf_counter() - started) * 1000 / n)
    read = graded(a.select("sample_id", "context", "abstained", "context_tokens", F.lit(spent).alias("latency_ms")), samples).withColumnRenamed("correct", "reader_correct")
    tokens = turns.groupBy("sample_id").agg(F.sum(lexical.estimated_tokens(F.col("text"))).alias("haystack_tokens"))
    j = samples.join(a.select("sample_id", "answer", "path", "query_type"), "sample_id").join(read.drop("category", "should_abstain"), "sample_id").join(tokens, "sample_id", "left")
    right = correct(F.col("answer"), F.col("abstained"), F.col("answer_keywords"), F.col("forbidden_keywords"), F.col("should_abstain"))
    out = j.withColumn("correct", right)
    if "expected_resolution" in samples.columns:
        won = state.edges.where("type = 'RESOLVED_TO'").select(F.col("start_id").alias("id"), F.col("end_id").alias("winner_id"))
        found = state.conflicts.join(won, "id").select(F.col("tenant").alias("sample_id"), "predicate", "winner_id")
        scores = resolution_scores(samples.select("sample_id", F.explode("expected_resolution").alias("predicate", "object")), found, state.facts)
        out = out.join(scores.select("sample_id", F.col("expected").alias("conflicts_expected"), F.col("correct").alias("conflicts_correct")), "sample_id", "left")
    return out.drop("question", "answer_keywords", "forbidden_keywords", "evidence_texts", "expected_resolution")


def ablation(samples: DataFrame, turns: DataFrame, configs: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """One row of metrics per configuration."""
    if unknown := [c for c in configs or () if c not in CONFIGS]:
        raise ValueError(f"unknown configurations {unknown}")
    rows = [metrics(run(samples, turns, c, now=now)).select(F.lit(c).alias("config"), "*") for c in configs or CONFIGS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def comparison(samples: DataFrame, turns: DataFrame, budget_tokens: int = 600, now: Column | None = None) -> DataFrame:
    """The baselines and the engine over the same samples under the same reader, a row each."""
    own = run(samples, turns, "full", now=now).drop("correct").withColumnRenamed("reader_correct", "correct")
    out = baseline_metrics(own).select(F.lit("engine").alias("name"), "*")
    for name in BASELINES:
        out = out.unionByName(baseline_metrics(baseline(name, turns, samples, budget_tokens)).select(F.lit(name).alias("name"), "*"))
    return out


def report(rows: DataFrame) -> str:
    """A small table of metrics as text, one line a row."""
    got = rows.collect()
    cells = [rows.columns] + [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in got]
    width = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells)
