"""The query language: one verb with its symbols, and filters after it.

    callers(f) path:src/ kind:function precise:true

A text becomes a QuerySpec, and a spec a DataFrame; masking is a view of the nodes that is
put in place before symbols are resolved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloft.functions.text import short_name
from graphloft.operators.aggregate import span_stats
from graphloft.operators.filters import NodeFilter, mask
from graphloft.operators.traverse import callers_within, search, shortest_path
from graphloft.schemas import GraphTables

VERBS = ("callers", "callees", "impact", "path", "latency")
PLAIN = ("path", "latency")
EDGE_ONLY = ("edge", "precise")


class QueryError(ValueError):
    """What is wrong with a query, and for a symbol that is not there, what is near it."""

    def __init__(self, text: str, suggestions: tuple = ()):
        super().__init__(text)
        self.suggestions = list(suggestions)


@dataclass(frozen=True)
class QuerySpec:
    verb: str
    args: tuple[str, ...]
    filters: NodeFilter = NodeFilter()


def parse(text: str) -> QuerySpec:
    """The spec of a query text; the call ends at the first ')'."""
    head, close, tail = text.strip().partition(")")
    verb, open_, inner = head.partition("(")
    verb = verb.strip()
    if not close or not open_:
        raise QueryError(f"expected verb(symbol), got {text!r}")
    if verb not in VERBS:
        raise QueryError(f"unknown query {verb!r}; known: {', '.join(VERBS)}")
    args = tuple(x.strip() for x in inner.split(",") if x.strip())
    if len(args) != (2 if verb == "path" else 1):
        raise QueryError(f"{verb} takes {'two symbols' if verb == 'path' else 'one symbol'}")
    got: dict = {}
    for word in tail.split():
        key, colon, value = word.partition(":")
        if not colon or not value:
            raise QueryError(f"a filter is key:value, got {word!r}")
        if key == "path" and value.startswith("!"):
            key, value = "path_exclude", value[1:]
        if key == "precise":
            if value not in ("true", "false"):
                raise QueryError("precise is true or false")
            value = value == "true"
        if key == "visibility" and value.lower() not in ("public", "private"):
            raise QueryError("visibility is public or private")
        if key not in NodeFilter.__dataclass_fields__:
            raise QueryError(f"unknown filter {key!r}")
        got[key] = value
    if got and verb in PLAIN:
        raise QueryError(f"{verb} takes no filters")
    if verb != "callers" and any(k in got for k in EDGE_ONLY):
        raise QueryError("edge and precise go with callers only")
    return QuerySpec(verb, args, NodeFilter(**got))


def resolve_symbol(nodes: DataFrame, symbol: str) -> int:
    """The id a symbol means: exact, then in any case, then by a short name that is unique."""
    s = F.col("symbol")
    rank = F.when(s == symbol, 0).when(F.lower(s) == symbol.lower(), 1).when((short_name(s) == symbol) | s.endswith(f".{symbol}"), 2)
    hits = nodes.select("id", "symbol", rank.alias("rank")).filter("rank IS NOT NULL").orderBy("rank", "id").limit(50).collect()
    if hits and hits[0]["rank"] < 2:
        return hits[0]["id"]
    if len(hits) == 1:
        return hits[0]["id"]
    if hits:
        raise QueryError(f"{symbol!r} is ambiguous", [h["symbol"] for h in hits])
    near = suggestions(nodes, symbol).collect()
    raise QueryError(f"no symbol {symbol!r}", [r["symbol"] for r in near])


def suggestions(nodes: DataFrame, symbol: str, limit: int = 5) -> DataFrame:
    """(symbol, distance): nearest symbols by edit distance, ties by name."""
    return nodes.select("symbol", F.levenshtein("symbol", F.lit(symbol)).cast("long").alias("distance")).distinct().orderBy("distance", "symbol").limit(limit)


def run(g: GraphTables, query: QuerySpec | str, visible: Column | None = None) -> DataFrame:
    """The query's rows: (id, symbol, path, kind, line_start, level), path's (pos, symbol), or latency's statistics."""
    spec = parse(query) if isinstance(query, str) else query
    nodes = g.nodes if visible is None else mask(g.nodes, visible)
    spark = nodes.sparkSession
    if spec.verb == "latency":
        return span_stats(g.spans.filter(F.col("symbol") == spec.args[0]), "symbol")
    ids = [resolve_symbol(nodes, a) for a in spec.args]
    if spec.verb == "path":
        return shortest_path(g.edges, *ids).join(nodes.select("id", "symbol"), "id").select("pos", "symbol")
    seed = spark.createDataFrame([(ids[0],)], "id long")
    if spec.verb == "callers":
        found = callers_within(g.edges, seed).filter(spec.filters.edge_condition() | (F.col("level") == 0))
    else:
        found = search(g.edges, seed, 1 if spec.verb == "callees" else None)
    shown = found.filter(F.col("id") != ids[0]).select("id", "level").join(nodes, "id").filter(spec.filters.condition())
    return shown.select("id", "symbol", "path", "kind", "line_start", "level")


def describe(df: DataFrame) -> str:
    """A result as lines of text, in the order of discovery."""
    rows = df.orderBy("level", "id").collect()
    return "\n".join(f"{r['symbol']} ({r['path']}:{r['line_start']})" for r in rows) or "no results"
