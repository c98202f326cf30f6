"""One object with the engine's operations, for programs and the command line."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.functions.text import split_identifier, token_count
from graphloft.operators import aggregate, analytics, filters, gates, records, search, traverse
from graphloft.plans import query, router
from graphloft.plans.store import Store, freshness
from graphloft.schemas import GraphTables


class Engine:
    """Operations on one graph; an identity limits every one of them to what it may see."""

    def __init__(self, tables: GraphTables, identity: filters.Identity | None = None):
        self.g, self.identity = tables, identity
        self.spark: SparkSession = tables.nodes.sparkSession
        self.visible = identity.visible() if identity else None

    @classmethod
    def open(cls, spark: SparkSession, path: str, identity: filters.Identity | None = None) -> Engine:
        return cls(Store(spark, path).read(), identity)

    @property
    def nodes(self) -> DataFrame:
        return self.g.nodes if self.visible is None else filters.mask(self.g.nodes, self.visible)

    def view(self) -> tuple[DataFrame, DataFrame]:
        return (self.g.nodes, self.g.edges) if self.visible is None else filters.drop_hidden(self.g.nodes, self.g.edges, self.visible)

    def get_node(self, node_id: int) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def get_edges(self, node_id: int) -> DataFrame:
        return self.g.edges.filter(F.col("src") == node_id)

    def query(self, text: str) -> DataFrame:
        return query.run(self.g, text, self.visible)

    def ask(self, question: str) -> DataFrame:
        """A question in plain words, grounded in all symbols of the graph.

        For each word of the question one aggregation tells the symbol that equals it and the
        first and last of those that hold it: what grounding asks of the whole table.
        """
        s, words = F.col("symbol"), sorted({w.lower() for w in router.candidates(question) if w})
        exact = [F.min(F.when(F.lower(s) == w, s)) for w in words]
        part = [f(F.when(F.contains(F.lower(s), F.lit(w)), s)) for w in words for f in (F.min, F.max)]
        found = self.nodes.agg(*[c.alias(f"c{i}") for i, c in enumerate([*exact, *part])]).first() if words else ()
        return self.query(router.expression(question, sorted({x for x in found if x is not None})))

    def repo_map(self, limit: int = 50, budget: int | None = None) -> DataFrame:
        top = aggregate.hub_files(*self.view(), limit)
        line = F.concat_ws(" ", "path", F.col("degree").cast("string"), F.col("symbols").cast("string"))
        return top if budget is None else aggregate.budget_prefix(top, line, budget, F.desc("degree"), "path")

    def file_api(self, path: str) -> DataFrame:
        return filters.cards(self.nodes.filter(F.col("path") == path)).orderBy("pos")

    def trace_calls(self, symbol: str, depth: int = 2, precise_only: bool = False) -> DataFrame:
        return traverse.call_trace(self.nodes, self.g.edges, query.resolve_symbol(self.nodes, symbol), depth, precise_only)

    def impact_radius(self, symbol: str) -> DataFrame:
        return self.query(f"impact({symbol})")

    def impact_tiers(self, symbol: str, budget: int) -> tuple[str, DataFrame]:
        """The finest of three tiers (symbols, files, folders) whose words fit the budget."""
        hit = self.impact_radius(symbol)
        full = hit.orderBy("id").limit(20).select(F.concat_ws(" ", "symbol", "path").alias("line"))
        files = aggregate.count_by(hit, "path").select(F.concat_ws(" ", "path", F.col("n").cast("string")).alias("line"))
        folders = aggregate.count_by(hit.withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1)), "folder").select(F.concat_ws(" ", "folder", F.col("n").cast("string")).alias("line"))
        for name, tier in (("full", full), ("files", files)):
            if (tier.agg(F.sum(token_count(F.col("line")))).first()[0] or 0) <= budget:
                return name, tier
        return "folders", folders

    def explore(self, symbol: str) -> dict[str, DataFrame]:
        node = query.resolve_symbol(self.nodes, symbol)
        path = self.nodes.filter(F.col("id") == node).first()["path"]
        return {"file": self.file_api(path), "impact": self.impact_radius(symbol), "trace": self.trace_calls(symbol, 2)}

    def search(self, text: str, limit: int = 20) -> DataFrame:
        """Ranked lexical hits; the literal scan only if there are none."""
        rows = search.lexical_rows(self.view()[0])
        hits = search.bm25(search.postings(rows), rows, text, limit)
        if hits.isEmpty():
            return filters.literal_search(self.view()[0], text).select("id", "symbol", "path").limit(min(limit, search.MOST))
        return hits.join(self.nodes, "id").select("rank", "id", "symbol", "path").orderBy("rank")

    def search_semantic(self, text: str, limit: int = 20) -> DataFrame:
        """Lexical and vector ranks fused."""
        from pyspark.sql import Window

        from graphloft.functions.text import embed, embed_text
        from graphloft.shipping import ship

        ship(self.spark)
        seen = self.view()[0]
        rows = search.lexical_rows(seen)
        wide = min(limit * 4, search.MOST)
        lexical = search.bm25(search.postings(rows), rows, text, wide).select(F.lit("lexical").alias("list"), "id", (F.col("rank") - 1).alias("rank0"))
        vectors = seen.select("id", embed(F.concat_ws(" ", split_identifier(F.col("symbol")), "signature")).alias("v"))
        near = search.vector_topk(vectors, embed_text(text).tolist(), wide).select(F.lit("vector").alias("list"), "id", (F.col("rank") - 1).alias("rank0"))
        fused = search.rrf(lexical.unionByName(near), limit).join(seen, "id")
        return fused.select("rank", "id", "symbol", "path", filters.direct_match(F.col("symbol"), F.col("path"), text).alias("direct")).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("rank")))

    def find_all(self, text: str, path: str | None = None, kind: str | None = None, lang: str | None = None) -> DataFrame:
        """Every hit; filters see masked rows as they are shown. Languages are those of filters.FIND_ALL."""
        rows = search.lexical_rows(self.g.nodes)
        hits = search.find_all(search.postings(rows), self.nodes, text).filter(filters.NodeFilter(path=path, kind=kind).condition())
        if lang is not None:
            hits = hits.filter(filters.has_language(F.col("path"), lang))
        return hits.orderBy("path", "line_start")

    def modules(self) -> DataFrame:
        return analytics.file_modules(*self.view())

    def policy_lint(self, rules: list[dict]) -> DataFrame:
        return gates.lint(*self.view(), [gates.Rule.load(r) for r in rules], self.identity.roles if self.identity else ())

    def blast(self, paths: list[str], direction: str = "callers", depth="2") -> DataFrame:
        return traverse.blast(*self.view(), self._paths(paths), direction, depth)

    def review(self, paths: list[str], rules: list[dict] = (), **more) -> gates.Review:
        none = self.spark.createDataFrame([], "path string, short_name string")
        return gates.review(*self.view(), self.g.more.get("unresolved_refs", none), self._paths(paths), [gates.Rule.load(r) for r in rules], self.identity or filters.Identity(), **more)

    def verify(self, paths: list[str] | None = None, guards: list[dict] = (), exempt=()) -> str:
        """pass, fail or incomplete: guards and phantom names; hidden rows leave it unproven."""
        n = gates.required_guards(*self.view(), list(guards)).count()
        if "unresolved_refs" in self.g.more:
            n += gates.phantom_symbols(self.g.unresolved_refs, self._paths(paths) if paths else None, exempt).count()
        hidden = 0 if self.visible is None else filters.hidden_counts(self.g.nodes, self.g.edges, self.visible).first()["hidden_nodes"]
        return gates.verdict(n, hidden)

    def recall_notes(self, now: int | None = None) -> DataFrame:
        return records.recall(self.g.notes, now or int(time.time()))

    def check_freshness(self, stored: str | None, head: str | None, dirty: bool = False) -> str:
        return freshness(stored, head, dirty)

    def neighborhood_json(self, symbol: str, depth: int = 1) -> str:
        """A node's surroundings as JSON text."""
        n, e = traverse.neighborhood(self.nodes, self.g.edges, query.resolve_symbol(self.nodes, symbol), depth)
        pick = lambda df, cols: [r.asDict() for r in df.select(*cols).orderBy(*cols).collect()]
        return json.dumps({"nodes": pick(n, ["id", "symbol", "path", "kind"]), "edges": pick(e, ["src", "dst", "kind"])})

    def report(self) -> str:
        """Counts, modules and hubs as Markdown."""
        n, e = self.view()
        lines = ["# Graph report", "", f"- symbols: {n.count()}", f"- edges: {e.count()}", f"- files: {n.select('path').distinct().count()}", "", "## Hubs", ""]
        lines += [f"- `{r['path']}`: {r['degree']} edges, {r['symbols']} symbols" for r in self.repo_map(10).collect()]
        top = aggregate.count_by(self.modules(), "module", "label").orderBy(F.desc("n"), "module").limit(20).collect()
        return "\n".join([*lines, "", "## Modules", "", *[f"- {r['label'] or '(top)'}: {r['n']} files" for r in top], ""])

    def canvas(self, limit: int = 200) -> str:
        """Modules and the weights between them as a JSON canvas; what is over the limit is one node."""
        n, e = self.view()
        members = self.modules()
        sizes = aggregate.capped(aggregate.count_by(members, "module", "label"), limit - 1, F.desc("n"), "module").orderBy(F.desc("n"), "module").collect()
        links = aggregate.inter_module_weights(aggregate.file_pair_weights(n, e), members.select("path", F.col("module").cast("string").alias("module"))).orderBy("a", "b").collect()
        side = max(1, int(len(sizes) ** 0.5 + 0.999))
        boxes = [{"id": str(r["module"]), "type": "text", "text": f"{r['label']} ({r['n']})", "x": 320 * (i % side), "y": 160 * (i // side), "width": 280, "height": 120} for i, r in enumerate(sizes)]
        if sizes and sizes[0]["over"]:
            boxes.append({"id": "more", "type": "text", "text": f"{sizes[0]['over']} more", "x": 0, "y": 160 * (side + 1), "width": 280, "height": 120})
        shown = {b["id"] for b in boxes}
        lines = [{"id": f"{r['a']}-{r['b']}", "fromNode": r["a"], "toNode": r["b"], "label": str(r["weight"])} for r in links if r["a"] in shown and r["b"] in shown]
        return json.dumps({"nodes": boxes, "edges": lines})

    def _paths(self, paths) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string")
