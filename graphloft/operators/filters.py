"""Predicates on nodes and edges, path rules, and identity-based masking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloft.functions.languages import is_public, language

# Roles with a meaning of their own, and what a hidden field shows.
INTERNAL, WAIVER = "internal", "allow-drift"
HIDDEN = "<rbac: hidden>"
# Languages that find-all can be limited to, by extension.
FIND_ALL = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp"}


def confidence(kind: Column, resolution: Column) -> Column:
    """'exact' or 'heuristic': by how a reference was resolved, else by the kind of edge."""
    weak = F.when(resolution.isNotNull(), resolution == "AMBIGUOUS_HEURISTIC").otherwise(F.coalesce(kind == "CALLS_DYNAMIC", F.lit(False)))
    return F.when(weak, "heuristic").otherwise("exact")


def in_module(path: Column, prefix: Column | str) -> Column:
    """Whether a path is a prefix or lies below it ('' holds every path)."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (p == "") | (path == p) | path.startswith(F.concat(p, F.lit("/")))


def glob_matches(path: Column, glob: str) -> Column:
    """'prefix/**' by folder, anything else by equality."""
    return in_module(path, glob[:-3]) if glob.endswith("/**") else path == glob


def any_glob(path: Column, globs) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | glob_matches(path, g)
    return out


def in_visibility(nodes_path: Column, signature: Column, symbol: Column, wanted: str) -> Column:
    public = is_public(language(nodes_path), signature, symbol, unknown=True)
    return public if wanted.lower() == "public" else ~public


@dataclass(frozen=True)
class NodeFilter:
    """The display filters of a query; None leaves a filter out."""

    path: str | None = None
    path_exclude: str | None = None
    kind: str | None = None
    lang: str | None = None
    visibility: str | None = None
    edge: str | None = None
    precise: bool | None = None

    def condition(self) -> Column:
        """What nodes (path, kind, signature, symbol) must fulfil."""
        c, path = F.lit(True), F.col("path")
        if self.path is not None:
            c = c & path.startswith(self.path)
        if self.path_exclude is not None:
            c = c & ~path.startswith(self.path_exclude)
        if self.kind is not None:
            c = c & (F.col("kind") == self.kind)
        if self.lang is not None:
            c = c & F.coalesce(F.lower(language(path)) == self.lang.lower(), F.lit(False))
        if self.visibility is not None:
            c = c & in_visibility(path, F.col("signature"), F.col("symbol"), self.visibility)
        return c

    def edge_condition(self) -> Column:
        """What the discovering edge (edge_kind, resolution_kind) must fulfil."""
        c = F.lit(True)
        if self.edge is not None:
            c = c & (F.col("edge_kind") == self.edge)
        if self.precise:
            c = c & (confidence(F.col("edge_kind"), F.col("resolution_kind")) == "exact")
        return c


def literal_search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose symbol, signature or path holds the text, in any case."""
    q = text.lower()
    hit = F.lit(False)
    for c in ("symbol", "signature", "path"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    return nodes.filter(hit)


def has_language(path: Column, lang: str) -> Column:
    """Whether find-all counts a file to a language; other languages have no files."""
    ends = [e for e, name in FIND_ALL.items() if name == lang.lower()]
    return F.regexp_extract(path, r"\.([^./]*)$", 1).isin(*ends) if ends else F.lit(False)


def direct_match(symbol: Column, path: Column, text: str) -> Column:
    return F.contains(F.lower(symbol), F.lit(text.lower())) | F.contains(F.lower(path), F.lit(text.lower()))


@dataclass(frozen=True)
class Identity:
    """Who asks: roles, and the paths that an internal identity is limited to (none: all)."""

    roles: tuple[str, ...] = ()
    scopes: tuple[str, ...] = field(default=())

    @property
    def internal(self) -> bool:
        return INTERNAL in self.roles

    @property
    def can_waive(self) -> bool:
        return WAIVER in self.roles

    def visible(self) -> Column:
        """Whether a node may be seen; for masking, an unknown language is not public."""
        public = is_public(language(F.col("path")), F.col("signature"), F.col("symbol"), unknown=False)
        if not self.internal:
            return public
        if not self.scopes:
            return F.lit(True)
        inside = F.lit(False)
        for s in self.scopes:
            inside = inside | in_module(F.col("path"), s)
        return inside | public


def mask(nodes: DataFrame, visible: Column) -> DataFrame:
    """Nodes with the content of hidden ones replaced; ids and repositories stay."""
    shown = {"path": HIDDEN, "symbol": HIDDEN, "kind": HIDDEN, "line_start": 0, "line_end": 0, "signature": ""}
    v = nodes.withColumn("_v", F.coalesce(visible, F.lit(False)))
    return v.select(*[F.when(F.col("_v"), F.col(c)).otherwise(F.lit(shown[c]).cast(t)).alias(c) if c in shown else F.col(c) for c, t in nodes.dtypes])


def drop_hidden(nodes: DataFrame, edges: DataFrame, visible: Column) -> tuple[DataFrame, DataFrame]:
    """Visible nodes, and the edges between them."""
    v = nodes.filter(F.coalesce(visible, F.lit(False)))
    ids = v.select("id")
    return v, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def hidden_counts(nodes: DataFrame, edges: DataFrame, visible: Column) -> DataFrame:
    """(hidden_nodes, skipped_edges): what a masked run did not see."""
    v, e = drop_hidden(nodes, edges, visible)
    n = nodes.agg(F.count(F.lit(1)).alias("a")).join(v.agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") - F.col("b")).alias("hidden_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("a")).join(e.agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") - F.col("b")).alias("skipped_edges"))
    return n.join(m)


def cards(nodes: DataFrame, compat: bool = False) -> DataFrame:
    """(path, kind, symbol, span, signature, pos): a file's symbols in order of lines (compat: of the span's text)."""
    from pyspark.sql import Window

    span = F.format_string("L%d-%d", "line_start", "line_end")
    order = [span] if compat else ["line_start", "line_end"]
    pos = F.row_number().over(Window.partitionBy("path").orderBy(*order, "symbol", "id"))
    return nodes.select("path", "kind", "symbol", span.alias("span"), "signature", pos.alias("pos"))
