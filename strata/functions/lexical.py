"""Scalar text functions of the memory engine as built-in column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------------------
STOPWORDS = """a an the is are was were be been am do does did i me my mine you your it its of in on at to for with and or but if then than
that this these those what which who whom when where why how can could would should will shall may might must have has had about into from by as
so up out there here now again ever any some tell say said know much many most s t re ve""".split()
SPELLING = {
    "colour": "color", "colours": "colors", "favourite": "favorite", "favourites": "favorites", "flavour": "flavor", "behaviour": "behavior",
    "organisation": "organization", "organise": "organize", "realise": "realize", "recognise": "recognize", "analyse": "analyze",
    "specialise": "specialize", "centre": "center", "litre": "liter", "metre": "meter", "defence": "defense", "licence": "license",
    "catalogue": "catalog", "dialogue": "dialog", "grey": "gray", "programme": "program",
}
ALIASES = {
    "i": "user", "me": "user", "my": "user", "myself": "user", "the user": "user", "js": "javascript", "ts": "typescript",
    "py": "python", "golang": "go", "postgres": "postgresql", "k8s": "kubernetes",
}
QUERY_CUES = {
    "temporal": ["when", "last time", "previously", "before", "after", "session", "first", "originally", "ago", "used to", "back then", "earlier", "how long", "since"],
    "preference": ["prefer", "like", "love", "hate", "favorite", "favourite", "want", "should i use", "recommend", "enjoy", "dislike"],
    "factual": ["what", "who", "where", "how many", "is it", "which", "name", "am i", "do i", "my"],
    "procedural": ["how do i", "how to", "steps to", "process for", "workflow", "set up", "configure", "how did i"],
}
CUE_WEIGHTS = {"temporal": 1.4, "preference": 1.3, "factual": 0.4, "procedural": 1.5}
HISTORY_CUES = ["before", "previously", "used to", "prior to", "earlier", "back then", "originally", "instead of", "at first", "switch from", "switched from"]
CHANGE_WORDS = ["changed", "change", "switch", "switched", "moved", "move", "still"]
VAGUE = """anything something everything nothing anyone someone everyone anybody somebody everybody moment moments day days week weeks month months
year years time times thing things stuff way ways kind kinds sort sorts currently lately recently nowadays today nowaday""".split()
PREDICATE_BASES = ["allergic_to", "lives_in", "works_at", "favorite", "favourite", "learning", "prefers", "likes", "uses", "role", "name", "has"]
FUNCTIONAL_PREFIXES = ["prefers", "name", "lives_in", "works_at", "favorite", "favourite", "role"]
CORRECTION_CUES = ["actually", "i meant", "correction", "to be clear", "sorry, i"]
UPDATE_CUES = ["switched", "moved to", "migrated", "no longer", "used to", "these days", "now ", "nowadays", "changed", "instead", "anymore", "recently"]
STATED = {
    "name": "{s}'s name is {o}", "prefers": "{s} prefers {o}", "likes": "{s} likes {o}", "lives_in": "{s} lives in {o}", "works_at": "{s} works at {o}",
    "favorite": "{s}'s favorite {cat} is {o}", "favourite": "{s}'s favourite {cat} is {o}", "role": "{s} is {o}", "uses": "{s} uses {o}",
    "learning": "{s} is learning {o}", "has": "{s} has {o}", "allergic_to": "{s} is allergic to {o}",
}
STATED_PAST = {
    "name": "{s}'s name was {o}", "prefers": "{s} preferred {o}", "likes": "{s} liked {o}", "lives_in": "{s} lived in {o}", "works_at": "{s} worked at {o}",
    "favorite": "{s}'s favorite {cat} was {o}", "favourite": "{s}'s favourite {cat} was {o}", "role": "{s} was {o}", "uses": "{s} used {o}",
    "learning": "{s} was learning {o}", "has": "{s} had {o}", "allergic_to": "{s} was allergic to {o}",
}
STATED_NOT = {
    "likes": "{s} dislikes {o}", "prefers": "{s} does not prefer {o}", "uses": "{s} no longer uses {o}", "learning": "{s} is not learning {o}", "has": "{s} does not have {o}",
}
# ------------------------------------------------------------------------------------------------


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def map_of(d: dict[str, str]) -> Column:
    """A constant map, built by one call: large constants made of columns cost a call an entry."""
    return F.expr(f"map({', '.join(literal(x) for kv in d.items() for x in kv)})")


def array_of(words: list[str]) -> Column:
    return F.expr(f"array({', '.join(map(literal, words))})")


_map = map_of


def _mapped(c: Column, d: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(_map(d), c), c)


def word_list(text: Column) -> Column:
    """Runs of a-z, 0-9, + and # of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9+#]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Words that carry content: no stop words, two characters at least; repeats stay."""
    return F.filter(word_list(text), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def stem_list(words: Column) -> Column:
    """Of each word: spelling normalised, a plural s dropped, the first five characters.

    Three passes over the array, so that no step is written out (and run) twice."""
    singular = lambda b: F.when((F.length(b) > 3) & F.endswith(b, F.lit("s")) & ~F.endswith(b, F.lit("ss")), F.substring(b, F.lit(1), F.length(b) - 1)).otherwise(b)
    normal = F.transform(words, lambda w: _mapped(w, SPELLING))
    return F.transform(F.transform(normal, singular), lambda c: F.substring(_mapped(c, SPELLING), 1, 5))


def stem(word: Column) -> Column:
    """:func:`stem_list` of one word."""
    return F.get(stem_list(F.array(word)), F.lit(0))


def stems(text: Column) -> Column:
    return F.array_distinct(stem_list(content_tokens(text)))


def overlap(query_tokens: Column, text_stems: Column, weights: Column | None = None, query_stems: Column | None = None) -> Column:
    """Share of the query's tokens (repeats count) whose stem the text has; with weights their share of
    the weight, an unknown token weighing 1. An empty query has no overlap. ``query_stems`` may hold the
    tokens' stems where a query meets many texts."""
    weight = lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(1.0)) if weights is not None else F.lit(1.0)
    pairs = F.zip_with(query_tokens, query_stems if query_stems is not None else stem_list(query_tokens), lambda t, s: F.struct(weight(t).alias("w"), F.array_contains(text_stems, s).alias("hit")))
    zero = F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("all"))
    add = lambda a, p: F.struct((a["got"] + F.when(p["hit"], p["w"]).otherwise(0.0)).alias("got"), (a["all"] + p["w"]).alias("all"))
    return F.aggregate(pairs, zero, add, lambda a: F.coalesce(F.try_divide(a["got"], a["all"]), F.lit(0.0)))


def plain_words(text: Column) -> Column:
    """Lower-case words of three letters or digits at least (any script); repeats stay."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", " ")), r"\s+"), lambda w: F.length(w) >= 3)


@cache
def _decomposed() -> tuple[str, str]:
    """Latin letters with marks, and their base letters."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(cp))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            src.append(chr(cp))
            dst.append(parts[0])
    return "".join(src), "".join(dst)


def canonical_name(name: Column) -> Column:
    """The key of an entity: decomposed and lower-cased, punctuation (marks too) as space, no leading
    article, spelling per word, then an alias of it or of its singular. Null becomes empty."""
    return F.get(canonical_list(F.array(F.coalesce(name, F.lit("")))), F.lit(0))


def canonical_list(names: Column) -> Column:
    """:func:`canonical_name` of every element, in passes over the array, so that no step is written out twice."""
    src, dst = _decomposed()

    def plain(name: Column) -> Column:
        marked = F.translate(F.regexp_replace(name, f"([{src}])", "$1\u0001"), src, dst)
        text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(marked), r"[^\p{L}\p{N}_\s\-]", " "), r"(?U)\s+", " "))
        text = F.regexp_replace(text, r"^(?:a|an|the) ", "")
        return F.array_join(F.transform(F.split(F.trim(text), r" +"), lambda w: _mapped(w, SPELLING)), " ")

    def singular(text: Column) -> Column:
        plural = (F.length(text) > 3) & F.endswith(text, F.lit("s")) & ~F.endswith(text, F.lit("ss"))
        one = F.substring(text, F.lit(1), F.length(text) - 1)
        return F.trim(F.when(plural, F.coalesce(F.try_element_at(_map(ALIASES), one), text)).otherwise(text))

    return F.transform(F.transform(F.transform(names, plain), lambda x: _mapped(x, ALIASES)), singular)


def canonical_text(name: str) -> str:
    """The same for a word of the driver's tables."""
    flat = "".join(c if c.isalnum() or c in "_- " else " " for c in unicodedata.normalize("NFKD", name).lower())
    words = flat.split()
    words = words[1:] if len(words) > 1 and words[0] in ("a", "an", "the") else words
    text = " ".join(SPELLING.get(w, w) for w in words)
    text = ALIASES.get(text, text)
    plural = len(text) > 3 and text.endswith("s") and not text.endswith("ss")
    return ALIASES.get(text[:-1], text) if plural else text


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space, and at line ends; trimmed, none empty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n - 1), r"\s+$", ""), F.lit("…")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, but one per word at least; 0 for nothing."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.coalesce(F.greatest(F.floor(F.length(text) / 4).cast("int"), words), F.lit(0))


def has_any(text: Column, cues: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, c: a | F.contains(low, F.lit(c)), cues[1:], F.contains(low, F.lit(cues[0])))


def wants_history(question: Column) -> Column:
    return has_any(question, HISTORY_CUES)


def cue_of(sentence: Column) -> Column:
    """correction, update or empty."""
    return F.when(has_any(sentence, CORRECTION_CUES), "correction").when(has_any(sentence, UPDATE_CUES), "update").otherwise("")


def classify(question: Column) -> Column:
    """struct(query_type, confidence): the kind whose cues weigh most, in the order of the table on ties;
    factual with 0.25 if no cue occurs."""
    low = F.lower(F.coalesce(question, F.lit("")))
    score = lambda kind: reduce(lambda a, c: a + F.contains(low, F.lit(c)).cast("int"), QUERY_CUES[kind], F.lit(0)) * CUE_WEIGHTS[kind]
    kinds = list(QUERY_CUES)
    scores = F.array(*[F.struct(score(k).cast("double").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(kinds)])
    best, total = F.array_max(scores), F.aggregate(scores, F.lit(0.0), lambda a, x: a + x["s"])
    known = total > 0
    return F.struct(F.when(known, best["k"]).otherwise("factual").alias("query_type"), F.when(known, F.bround(best["s"] / total, 4)).otherwise(0.25).alias("confidence"))


def framing_words() -> list[str]:
    """Words that shape a question rather than name its subject: cue words and vague ones."""
    import re

    phrases = [*HISTORY_CUES, *QUERY_CUES["temporal"], *QUERY_CUES["procedural"], *CHANGE_WORDS]
    return sorted({w for p in phrases for w in re.findall("[a-z0-9+#]+", p)} | set(VAGUE))


def weighable(token: Column) -> Column:
    """Tokens that document frequency may weigh."""
    return ((F.length(token) >= 3) | token.rlike(r"^\d+$")) & ~token.isin(framing_words())


def base_and_category(predicate: Column) -> Column:
    """struct(base, category) of ``base_category@qualifier``; an unknown base is the predicate itself."""
    p = F.split_part(predicate, F.lit("@"), F.lit(1))
    out = F.struct(p.alias("base"), F.lit("").alias("category"))
    for b in reversed(PREDICATE_BASES):
        own = F.struct(F.lit(b).alias("base"), F.when(p == b, "").otherwise(F.substring(p, F.lit(len(b) + 2), F.length(p))).alias("category"))
        out = F.when((p == b) | F.startswith(p, F.lit(b + "_")), own).otherwise(out)
    return out


def is_functional(predicate: Column) -> Column:
    """True where a new object replaces the old one."""
    p = F.split_part(predicate, F.lit("@"), F.lit(1))
    return reduce(lambda a, b: a | F.startswith(p, F.lit(b)), FUNCTIONAL_PREFIXES[1:], F.startswith(p, F.lit(FUNCTIONAL_PREFIXES[0])))


def rendered_fact(subject: Column, predicate: Column, obj: Column, qualifier: Column | None = None, negated: Column | None = None, past: Column | None = None) -> Column:
    """A stored triple as a sentence."""
    parts = base_and_category(predicate)
    base, no, was = parts["base"], negated if negated is not None else F.lit(False), past if past is not None else F.lit(False)
    words = F.replace(base, F.lit("_"), F.lit(" "))
    known = F.when(no, F.try_element_at(_map(STATED_NOT), base)).when(was, F.try_element_at(_map(STATED_PAST), base)).otherwise(F.try_element_at(_map(STATED), base))
    plain = F.when(no, F.concat(F.lit("{s} does not "), words, F.lit(" {o}"))).otherwise(F.concat(F.lit("{s} "), words, F.lit(" {o}")))
    cat = F.replace(parts["category"], F.lit("_"), F.lit(" "))
    text = F.coalesce(known, plain)
    for slot, value in (("{s}", subject), ("{cat}", F.when(cat == "", "one").otherwise(cat)), ("{o}", obj)):
        text = F.replace(text, F.lit(slot), F.coalesce(value, F.lit("")))
    if qualifier is not None:
        text = F.concat(text, F.when(F.coalesce(qualifier, F.lit("")) == "", "").otherwise(F.concat(F.lit(" (for "), qualifier, F.lit(")"))))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def joined(items: Column) -> Column:
    """"a", "a and b", "a, b and c" of the distinct non-empty items in order."""
    own = F.array_distinct(F.filter(items, lambda x: x != ""))
    n = F.size(own)
    return F.when(n <= 1, F.coalesce(F.get(own, F.lit(0)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(own, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(own, n - 1)))
