"""Deeply nested records as related flat tables (shared inlining).

``plan_relations`` analyses a schema graph: an element that can occur once below
a single parent is inlined into the parent's table; one that repeats, has several
parents or reaches itself gets a table of its own, with a foreign key (the
positions of the way down to it). ``shred`` runs such a plan over VARIANT values
with built-in generators, so nothing is parsed twice and nothing leaves the JVM.

Defined cases: a payload that is null, empty, damaged or followed by other text
gives nothing (nor does one with a repeated key in one object, since it has no
single meaning); positions count null and empty elements; a missing array is an
empty one; a record without sessions gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.plan import hold
from strata.functions.text import trim_all, visible


@dataclass(frozen=True)
class Element:
    """An element of the schema graph: its scalars (name to type) and children (name to (element, repeats))."""

    scalars: Mapping[str, str] = field(default_factory=dict)
    children: Mapping[str, tuple[str, bool]] = field(default_factory=dict)


@dataclass
class Relation:
    """One table: ``columns`` maps a flat name to (path, type); ``parents`` lists (parent table, path)."""

    name: str
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)
    parents: list[tuple[str, str]] = field(default_factory=list)


def schema_graph(schema: T.StructType, root: str = "root") -> dict[str, Element]:
    """The graph of a Spark schema; structs of equal fields under one name are one shared element."""
    graph: dict[str, Element] = {}

    def visit(name: str, st: T.StructType) -> str:
        scalars: dict[str, str] = {}
        children: dict[str, tuple[str, bool]] = {}
        for f in st.fields:
            kind, many = f.dataType, False
            while isinstance(kind, T.ArrayType):
                kind, many = kind.elementType, True
            if isinstance(kind, T.StructType):
                children[f.name] = (visit(f.name, kind), many)
            elif many:
                graph.setdefault(f.name, Element({"value": kind.simpleString()}))
                children[f.name] = (f.name, True)
            else:
                scalars[f.name] = kind.simpleString()
        key = name
        while key in graph and graph[key] != Element(scalars, children):
            key += "_"
        graph[key] = Element(scalars, children)
        return key

    visit(root, schema)
    return graph


def plan_relations(graph: Mapping[str, Element], root: str) -> dict[str, Relation]:
    """Tables by shared inlining, the root's first."""
    parents: dict[str, set[str]] = {n: set() for n in graph}
    repeated: set[str] = set()
    for name, e in graph.items():
        for child, many in e.children.values():
            parents[child].add(name)
            if many:
                repeated.add(child)

    def reaches(a: str, b: str, seen: frozenset[str] = frozenset()) -> bool:
        return any(c == b or (c not in seen and reaches(c, b, seen | {c})) for c, _ in graph[a].children.values())

    uses = {n: sum(c == n for e in graph.values() for c, _ in e.children.values()) for n in graph}
    own = {n for n in graph if n == root or n in repeated or uses[n] > 1 or reaches(n, n)}
    out: dict[str, Relation] = {root: Relation(root)}

    def fill(rel: Relation, element: str, path: str, prefix: str) -> None:
        for s, kind in graph[element].scalars.items():
            rel.columns[prefix + s] = (f"{path}.{s}", kind)
        for label, (child, _) in graph[element].children.items():
            if child in own:
                new = child not in out
                target = out.setdefault(child, Relation(child))
                target.parents.append((rel.name, f"{path}.{label}"))
                if new:
                    fill(target, child, "$", "")
            else:
                fill(rel, child, f"{path}.{label}", f"{prefix}{label}_")

    fill(out[root], root, "$", "")
    return out


def get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def parse_whole(c: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null (the parser alone accepts trailing text)."""
    wrapped = get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("\n]"))), "$", "array<variant>")
    return F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def text_of(v: Column) -> Column:
    """Text of a value that is a string or a list of parts with a text; else null."""
    parts = get(v, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(get(p, "$.text", "string"), F.when(_is_text(p), get(p, "$", "string")))), "\n")
    return F.when(parts.isNotNull(), joined).when(_is_text(v), get(v, "$", "string"))


#: session payloads: what may nest in what
SESSION_GRAPH = {
    "record": Element({}, {"sessions": ("session", True)}),
    "session": Element(
        {"session_id": "string", "user_id": "string", "session_number": "int", "timestamp": "string", "start_time": "string", "tz": "string", "session_summary": "string"},
        {"client": ("client", False), "turns": ("turn", True)},
    ),
    "client": Element({"app": "string"}, {"build": ("build", False)}),
    "build": Element({"major": "int"}, {"tags": ("tag", True)}),
    "tag": Element(),
    "turn": Element({"speaker": "string", "role": "string", "timestamp": "string"}, {"meta": ("meta", False), "attachments": ("attachment", True)}),
    "meta": Element({"lang": "string", "score": "double"}),
    "attachment": Element({"kind": "string", "name": "string"}, {"refs": ("ref", True)}),
    "ref": Element({"turn": "int"}),
}


def shred(df: DataFrame, keys: list[str], value: str, rel: Relation, path: str, pos: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of one child relation: the parent's keys, the position, the inlined columns and the element itself."""
    # the outer form, since a filter inferred from the inner one would evaluate the array twice
    rows = df.select(*keys, F.posexplode_outer(get(F.col(value), path, "array<variant>")).alias(pos, "item_")).where("item_ is not null")
    cols = [get(F.col("item_"), p, kind).alias(name) for name, (p, kind) in rel.columns.items() if name not in keys]
    return rows.select(*keys, pos, "item_", *cols, *[c.alias(n) for n, c in (extra or {}).items()])


def unwrap_sessions(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, sessions array<variant>): a lone session, a list, or either inside wrappers (``sessions``,
    ``export``, ``data``), where ``data`` may again be JSON text. Each value is parsed once, in steps."""
    wrappers = ("$.sessions", "$.export.sessions", "$.data.sessions", "$.data", "$.export")
    v = df.select(key, parse_whole(F.col(payload)).alias("v_"))
    v = v.select(key, "v_", get(F.col("v_"), "$.data", "variant").alias("data_"))
    text = F.when(_is_text(F.col("data_")), get(F.col("data_"), "$", "string"))
    v = v.select(key, F.when(F.col("data_").isNotNull() & _is_text(F.col("data_")), parse_whole(text)).otherwise(F.col("v_")).alias("v_"))
    listed = F.coalesce(get(F.col("v_"), "$", "array<variant>"), *[get(F.col("v_"), p, "array<variant>") for p in wrappers])
    return v.select(key, "v_", listed.alias("list_")).select(key, F.coalesce("list_", F.when(F.col("v_").isNotNull(), F.array("v_"))).alias("sessions_"))


def session_rows(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row per session element that is an object: key, session_pos, its columns and ``item_``."""
    rel = plan_relations(SESSION_GRAPH, "record")["session"]
    rows = unwrap_sessions(df, key, payload).select(key, F.posexplode_outer("sessions_").alias("session_pos", "item_")).where(_is_object(F.col("item_")))
    return rows.select(key, "session_pos", "item_", *[get(F.col("item_"), p, kind).alias(name) for name, (p, kind) in rel.columns.items()])


def turn_rows(sessions: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per turn with non-blank text: key, positions, speaker, text, timestamp and ``item_``."""
    rel = plan_relations(SESSION_GRAPH, "record")["turn"]
    rows = shred(sessions.select(key, "session_pos", F.col("item_").alias("session_")), [key, "session_pos"], "session_", rel, "$.turns", "turn_pos")
    item = F.col("item_")
    keep = [c for c in rel.columns if c not in ("speaker", "role")]
    given = F.when(visible(F.col("speaker")), F.col("speaker")).when(visible(F.col("role")), F.col("role"))
    rows = rows.select(
        key, "session_pos", "turn_pos", "item_", *keep,
        F.lower(trim_all(F.coalesce(given, F.lit("user")))).alias("speaker"),
        F.when(_is_text(item), get(item, "$", "string")).alias("bare_"),
        get(item, "$.text", "variant").alias("text_"),
        get(item, "$.content", "variant").alias("content_"),
    )
    rows = rows.select(key, "session_pos", "turn_pos", "item_", *keep, "speaker", "bare_", text_of(F.col("text_")).alias("text_"), text_of(F.col("content_")).alias("content_"))
    text = F.coalesce("bare_", F.when(visible(F.col("text_")), F.col("text_")), "content_")
    return hold(rows, text=text).select(key, "session_pos", "turn_pos", "item_", *keep, "speaker", "text").where(visible(F.col("text")))


def _bare(item: Column) -> Column:
    return F.when(_is_text(item), get(item, "$", "string"))


def attachment_rows(turns: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per named attachment of the given turns; a bare string is a name."""
    rel = plan_relations(SESSION_GRAPH, "record")["attachment"]
    rows = shred(turns.select(key, "session_pos", "turn_pos", F.col("item_").alias("turn_")), [key, "session_pos", "turn_pos"], "turn_", rel, rel.parents[0][1], "att_pos")
    name = F.coalesce("name", _bare(F.col("item_")))
    return hold(rows, name=name).select(key, "session_pos", "turn_pos", "att_pos", "kind", "name", "item_").where(visible(F.col("name")))


def children(item: Column, rel: Relation, parent: str, pos: str) -> Column:
    """The rows of a planned child relation of one element, as an array of structs: position, the inlined columns of
    the plan and ``bare`` for an element that is a plain text. For joining levels without reading a value twice."""
    path = next(p for table, p in rel.parents if table == parent)
    found = F.coalesce(get(item, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(found, lambda a, i: F.struct(i.alias(pos), _bare(a).alias("bare"), *[get(a, p, kind).alias(name) for name, (p, kind) in rel.columns.items()]))


#: name of the position column of each table, in the order of the way down
POSITIONS = {"session": "session_pos", "turn": "turn_pos", "attachment": "att_pos", "tag": "tag_pos", "ref": "ref_pos"}


def tables(df: DataFrame, graph: Mapping[str, Element] = SESSION_GRAPH, root: str = "record", key: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """Every table of the plan below the root with its rows: the foreign key (the record's key and the positions of
    the way down), its own position, and its inlined columns. A table reached in several ways holds the rows of all,
    the positions it has not passed being null; a recursive element is followed one level, its deeper levels by
    applying the plan again to its rows."""
    plan = plan_relations(graph, root)
    pos = lambda name: POSITIONS.get(name, f"{name}_pos")
    top = next(n for n, r in plan.items() if any(p == root for p, _ in r.parents))
    first = unwrap_sessions(df, key, payload).select(key, F.posexplode_outer("sessions_").alias(pos(top), "item_")).where(_is_object(F.col("item_")))
    levels: dict[str, list[DataFrame]] = {top: [first]}
    way: dict[str, list[str]] = {top: [key, pos(top)]}
    for name, rel in plan.items():
        for parent, path in rel.parents:
            if parent == root or parent == name or parent not in levels:
                continue
            keys = way[parent]
            for rows in levels[parent]:
                got = rows.select(*keys, F.posexplode_outer(get(F.col("item_"), path, "array<variant>")).alias(pos(name), "child_")).where("child_ is not null")
                levels.setdefault(name, []).append(got.select(*keys, pos(name), F.col("child_").alias("item_")))
                way.setdefault(name, [*keys, pos(name)])
    out = {}
    for name, parts in levels.items():
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        cols = [get(F.col("item_"), p, kind).alias(c) for c, (p, kind) in plan[name].columns.items() if c not in rows.columns]
        out[name] = rows.select(*[c for c in rows.columns if c != "item_"], _bare(F.col("item_")).alias("bare"), *cols)
    return out
