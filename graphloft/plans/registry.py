"""The engine's registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.functions import text as X
from graphloft.functions.languages import contract_short_name
from graphloft.operators import aggregate as A
from graphloft.operators import federation as FED
from graphloft.operators import filters as FL
from graphloft.operators import gates as GT
from graphloft.operators import mutation as M
from graphloft.operators import records as R
from graphloft.operators import resolve as RS
from graphloft.operators import search as S
from graphloft.operators import traverse as T
from graphloft.operators.analytics import strong_components, topological_levels
from graphloft.plans.query import run, suggestions
from graphloft.sources.markup import page_classes, page_links, page_scripts
from graphloft.sources.projection import OFFSET
from graphloft.sources.projection import SQL as GRAPH
from graphloft.sources.projection import graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query, with its SQL if there is one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _seed(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


CUSTOMER = OFFSET["customer"] + 7
REGION = OFFSET["region"] + 1
SUPPLIER = OFFSET["supplier"] + 3
WITH, REC = f"WITH {GRAPH}", f"WITH RECURSIVE {GRAPH}"


# Projection, scans, counts
@query(f"{WITH} SELECT * FROM nodes")
def graph_nodes(spark, sf):
    return graph(spark, sf).nodes


@query(f"{WITH} SELECT * FROM edges")
def graph_edges(spark, sf):
    return graph(spark, sf).edges.drop("extractor")


@query(f"{WITH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark, sf):
    g = graph(spark, sf)
    return g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))


@query(f"{WITH} SELECT id, symbol, path FROM nodes WHERE symbol = 'part::11' ORDER BY id LIMIT 1")
def node_by_symbol(spark, sf):
    return graph(spark, sf).nodes.filter("symbol = 'part::11'").orderBy("id").limit(1).select("id", "symbol", "path")


@query(f"{WITH} SELECT dst, kind, resolution_kind FROM edges WHERE src = {CUSTOMER}")
def outbound_edges(spark, sf):
    return graph(spark, sf).edges.filter(F.col("src") == CUSTOMER).select("dst", "kind", "resolution_kind")


@query(f"{WITH} SELECT src, kind, resolution_kind FROM edges WHERE dst = {SUPPLIER}")
def inbound_edges(spark, sf):
    return graph(spark, sf).edges.filter(F.col("dst") == SUPPLIER).select("src", "kind", "resolution_kind")


# Traversal
@query(f"{WITH} SELECT n.id, n.symbol, n.path, n.kind, n.line_start, 1 AS level FROM (SELECT DISTINCT dst FROM edges WHERE src = {CUSTOMER}) e JOIN nodes n ON n.id = e.dst")
def callees_one_hop(spark, sf):
    return run(graph(spark, sf), "callees(customer::7)")


_FORWARD = f"{REC}, r(id) AS (SELECT {CUSTOMER}::BIGINT UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id)"
_BACKWARD = f"{REC}, r(id) AS (SELECT {SUPPLIER}::BIGINT UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.id)"


@query(f"{_FORWARD} SELECT n.symbol, n.path, n.kind FROM r JOIN nodes n USING (id) WHERE id <> {CUSTOMER}")
def impact_unbounded(spark, sf):
    return run(graph(spark, sf), "impact(customer::7)").select("symbol", "path", "kind")


@query(f"{_FORWARD} SELECT n.symbol FROM r JOIN nodes n USING (id) WHERE id <> {CUSTOMER} AND starts_with(n.path, 'part/') AND NOT starts_with(n.path, 'part/Brand#1') AND n.kind = 'part'")
def impact_filtered(spark, sf):
    return run(graph(spark, sf), "impact(customer::7) path:part/ path:!part/Brand#1 kind:part").select("symbol")


@query(f"{_BACKWARD} SELECT n.symbol, n.kind FROM r JOIN nodes n USING (id) WHERE id <> {SUPPLIER}")
def callers_unbounded(spark, sf):
    return run(graph(spark, sf), "callers(supplier::3)").select("symbol", "kind")


_LEVELS = "{rec}, r(id, d) AS (SELECT {seed}::BIGINT, 0 UNION ALL SELECT DISTINCT e.{to}, d + 1 FROM r JOIN edges e ON e.{of} = r.id WHERE d < {k})"


@query(_LEVELS.format(rec=REC, seed=CUSTOMER, of="src", to="dst", k=3) + " SELECT id, min(d) AS level FROM r GROUP BY id")
def reach_k_forward(spark, sf):
    return T.reachable_within(graph(spark, sf).edges, _seed(spark, CUSTOMER), 3).select("id", "level")


@query(_LEVELS.format(rec=REC, seed=SUPPLIER, of="dst", to="src", k=2) + " SELECT id, min(d) AS level FROM r GROUP BY id")
def reach_k_backward(spark, sf):
    return T.callers_within(graph(spark, sf).edges, _seed(spark, SUPPLIER), 2).select("id", "level")


_FIRST = "(SELECT src, min((kind, resolution_kind)) AS k FROM edges WHERE dst = {0} GROUP BY src)".format(SUPPLIER)


@query(f"""{_LEVELS.format(rec=REC, seed=SUPPLIER, of='dst', to='src', k=2)},
  lv AS (SELECT id, min(d) AS d FROM r GROUP BY id),
  f AS (SELECT l.id, arg_min(e.kind, (e.dst, e.kind)) AS kind, arg_min(coalesce(e.resolution_kind, ''), (e.dst, e.kind)) AS how FROM lv l JOIN edges e ON e.src = l.id JOIN lv p ON p.id = e.dst AND p.d = l.d - 1 GROUP BY l.id)
  SELECT n.symbol FROM f JOIN nodes n USING (id) WHERE how <> 'AMBIGUOUS_HEURISTIC' AND f.kind = 'CONTAINS'""")
def filter_precise(spark, sf):
    g = graph(spark, sf)
    f = FL.NodeFilter(edge="CONTAINS", precise=True)
    return T.callers_within(g.edges, _seed(spark, SUPPLIER), 2).filter(f.edge_condition()).filter("level > 0").join(g.nodes, "id").select("symbol")


@query(f"""{_FORWARD} SELECT CAST(3 AS INT) AS hops, count(*) AS reached FROM r""", name="impact_size")
def impact_size(spark, sf):
    return T.reachable_within(graph(spark, sf).edges, _seed(spark, CUSTOMER)).agg(F.lit(3).alias("hops"), F.count(F.lit(1)).alias("reached"))


_PATH = f"""{_LEVELS.format(rec=REC, seed=CUSTOMER, of='src', to='dst', k=6)},
  lv AS (SELECT id, min(d) AS d FROM r GROUP BY id),
  pr AS (SELECT l.id, l.d, (SELECT min(e.src) FROM edges e JOIN lv p ON p.id = e.src WHERE e.dst = l.id AND p.d = l.d - 1) AS pred FROM lv l),
  w(pos, id) AS (SELECT d, id FROM pr WHERE id = {REGION} UNION ALL SELECT w.pos - 1, pr.pred FROM w JOIN pr ON pr.id = w.id WHERE pr.pred IS NOT NULL)"""


@query(f"{_PATH} SELECT pos, symbol FROM w JOIN nodes USING (id)")
def shortest_path_nodes(spark, sf):
    return run(graph(spark, sf), "path(customer::7, region::1)")


@query(f"""{_LEVELS.format(rec=REC, seed=CUSTOMER, of='src', to='dst', k=1)}, b(id, d) AS (SELECT {CUSTOMER}::BIGINT, 0 UNION ALL SELECT DISTINCT e.src, d + 1 FROM b JOIN edges e ON e.dst = b.id WHERE d < 1),
  ids AS (SELECT id FROM r UNION SELECT id FROM b) SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""")
def neighborhood_edges(spark, sf):
    g = graph(spark, sf)
    return T.neighborhood(g.nodes, g.edges, CUSTOMER, 1)[1].select("src", "dst", "kind")


_CHANGED = "ch AS (SELECT 'part/Brand#11' AS path UNION ALL SELECT 'supplier/3')"
_BLAST = f"{REC}, {_CHANGED}, r(id, d) AS (SELECT id, 0 FROM nodes WHERE path IN (SELECT path FROM ch) UNION SELECT e.src, d + 1 FROM r JOIN edges e ON e.dst = r.id WHERE d < 1), hit AS (SELECT id, min(d) AS level FROM r GROUP BY id)"


def _changed(spark):
    return spark.createDataFrame([("part/Brand#11",), ("supplier/3",)], "path string")


@query(f"{_BLAST} SELECT * FROM hit")
def multi_seed_blast(spark, sf):
    g = graph(spark, sf)
    return T.blast(g.nodes, g.edges, _changed(spark), "callers", 1)


@query(f"{_BLAST} SELECT path, count(*) AS n FROM hit JOIN nodes USING (id) GROUP BY path")
def blast_by_file(spark, sf):
    g = graph(spark, sf)
    return A.count_by(T.blast(g.nodes, g.edges, _changed(spark), "callers", 1).join(g.nodes, "id"), "path")


@query(f"""{_BLAST}, c AS (SELECT (SELECT count(*) FROM hit) AS impacted, (SELECT count(*) FROM nodes WHERE path IN (SELECT path FROM ch)) AS exported)
  SELECT impacted, exported, CASE WHEN impacted >= 50 AND exported > 0 THEN 'Critical' WHEN impacted >= 50 OR exported >= 3 THEN 'High' WHEN impacted >= 10 OR exported > 0 THEN 'Medium' ELSE 'Low' END AS risk FROM c""")
def blast_risk(spark, sf):
    g = graph(spark, sf)
    n = T.blast(g.nodes, g.edges, _changed(spark), "callers", 1).agg(F.count(F.lit(1)).alias("impacted"))
    m = GT.exported_touched(g.nodes, _changed(spark)).agg(F.count(F.lit(1)).alias("exported"))
    return n.join(m).withColumn("risk", GT.risk(F.col("impacted"), F.col("exported")))


# Filters
@query(f"{WITH} SELECT id FROM nodes WHERE starts_with(path, 'orders/1') AND kind = 'orders'")
def filter_path_kind(spark, sf):
    return graph(spark, sf).nodes.filter(FL.NodeFilter(path="orders/1", kind="orders").condition()).select("id")


@query(f"{WITH} SELECT path, count(*) AS n FROM nodes WHERE NOT starts_with(path, 'orders/') GROUP BY path")
def filter_path_exclude(spark, sf):
    return A.count_by(graph(spark, sf).nodes.filter(FL.NodeFilter(path_exclude="orders/").condition()), "path")


_AS_RS = f"{WITH}, rs AS (SELECT id, repo_id, path || '.rs' AS path, symbol, kind, line_start, line_end, signature FROM nodes WHERE kind IN ('part', 'nation', 'supplier'))"


def _rs(spark, sf):
    n = graph(spark, sf).nodes.filter(F.col("kind").isin("part", "nation", "supplier"))
    return n.withColumn("path", F.concat("path", F.lit(".rs")))


_PUBLIC = "(starts_with(trim(signature), 'pub') AND NOT starts_with(trim(signature), 'pub('))"


@query(f"{_AS_RS} SELECT id, path FROM rs WHERE {_PUBLIC}")
def filter_visibility(spark, sf):
    return _rs(spark, sf).filter(FL.NodeFilter(visibility="public", lang="rust").condition()).select("id", "path")


@query(f"{WITH} SELECT kind, count(*) AS n FROM nodes WHERE path = 'part' OR starts_with(path, 'part/') OR path = 'nation/1' OR starts_with(path, 'nation/1/') GROUP BY kind")
def boundary_paths(spark, sf):
    n = graph(spark, sf).nodes
    return A.count_by(n.filter(FL.glob_matches(F.col("path"), "part/**") | FL.in_module(F.col("path"), "nation/1")), "kind")


@query(f"{WITH} SELECT id FROM nodes WHERE contains(lower(symbol), 'part::1') OR contains(lower(signature), 'part::1') OR contains(lower(path), 'part::1')")
def literal_search(spark, sf):
    return FL.literal_search(graph(spark, sf).nodes, "Part::1").select("id")


@query(f"{WITH} SELECT kind, count(*) FILTER (WHERE resolution_kind = 'AMBIGUOUS_HEURISTIC') AS heuristic, count(*) FILTER (WHERE resolution_kind IS DISTINCT FROM 'AMBIGUOUS_HEURISTIC') AS exact FROM edges GROUP BY kind")
def edge_confidence(spark, sf):
    c = FL.confidence(F.col("kind"), F.col("resolution_kind"))
    return graph(spark, sf).edges.groupBy("kind").agg(F.count_if(c == "heuristic").alias("heuristic"), F.count_if(c == "exact").alias("exact"))


_VISIBLE = f"({_PUBLIC} OR path = 'supplier/3.rs')"
_WHO = FL.Identity(roles=("internal",), scopes=("supplier/3.rs",))


@query(f"{_AS_RS} SELECT id, repo_id, CASE WHEN {_VISIBLE} THEN path ELSE '<rbac: hidden>' END AS path, CASE WHEN {_VISIBLE} THEN symbol ELSE '<rbac: hidden>' END AS symbol, CASE WHEN {_VISIBLE} THEN kind ELSE '<rbac: hidden>' END AS kind, CASE WHEN {_VISIBLE} THEN line_start ELSE 0 END AS line_start, CASE WHEN {_VISIBLE} THEN line_end ELSE 0 END AS line_end, CASE WHEN {_VISIBLE} THEN signature ELSE '' END AS signature FROM rs")
def mask_nodes(spark, sf):
    return FL.mask(_rs(spark, sf), _WHO.visible())


_DROP = f"{_AS_RS}, v AS (SELECT id FROM rs WHERE {_VISIBLE}), re AS (SELECT e.* FROM edges e WHERE src IN (SELECT id FROM rs) AND dst IN (SELECT id FROM rs))"


def _rs_edges(spark, sf):
    ids = _rs(spark, sf).select("id")
    e = graph(spark, sf).edges
    return e.join(ids, e["src"] == ids["id"], "left_semi").join(ids, e["dst"] == ids["id"], "left_semi")


@query(f"{_DROP} SELECT src, dst, kind FROM re WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def drop_hidden_edges(spark, sf):
    return FL.drop_hidden(_rs(spark, sf), _rs_edges(spark, sf), _WHO.visible())[1].select("src", "dst", "kind")


@query(f"{_DROP} SELECT (SELECT count(*) FROM rs) - (SELECT count(*) FROM v) AS hidden_nodes, (SELECT count(*) FROM re) - (SELECT count(*) FROM re WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)) AS skipped_edges")
def hidden_counts(spark, sf):
    return FL.hidden_counts(_rs(spark, sf), _rs_edges(spark, sf), _WHO.visible())


@query(f"{_AS_RS} SELECT id, symbol FROM rs WHERE {_VISIBLE} ORDER BY line_start DESC, id LIMIT 10")
def masked_topk(spark, sf):
    return _rs(spark, sf).filter(_WHO.visible()).orderBy(F.desc("line_start"), "id").limit(10).select("id", "symbol")


@query(f"{WITH} SELECT path, kind, symbol, 'L' || line_start || '-' || line_end AS span, signature, row_number() OVER (PARTITION BY path ORDER BY line_start, line_end, symbol, id)::INT AS pos FROM nodes WHERE kind IN ('part', 'region')")
def file_cards(spark, sf):
    return FL.cards(graph(spark, sf).nodes.filter(F.col("kind").isin("part", "region")))


# Aggregation, top-k
_FP = "fp AS (SELECT least(a.path, b.path) AS a, greatest(a.path, b.path) AS b, count(*) AS weight FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.path <> b.path GROUP BY ALL)"


@query(f"{WITH}, {_FP} SELECT * FROM fp")
def file_pair_weights(spark, sf):
    g = graph(spark, sf)
    return A.file_pair_weights(g.nodes, g.edges)


@query(f"{WITH}, {_FP}, m AS (SELECT DISTINCT path, split_part(path, '/', 1) AS module FROM nodes) SELECT least(x.module, y.module) AS a, greatest(x.module, y.module) AS b, sum(weight)::BIGINT AS weight FROM fp JOIN m x ON x.path = fp.a JOIN m y ON y.path = fp.b WHERE x.module <> y.module GROUP BY ALL")
def inter_group_weights(spark, sf):
    g = graph(spark, sf)
    return A.inter_module_weights(A.file_pair_weights(g.nodes, g.edges), g.nodes.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).distinct())


@query(f"{WITH}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM edges WHERE src <> dst AND weight > 0 GROUP BY ALL) SELECT node, round(sum(w), 4) AS degree FROM (SELECT a AS node, w FROM u UNION ALL SELECT b, w FROM u) GROUP BY node")
def weighted_degree(spark, sf):
    return A.weighted_degree(A.undirected(graph(spark, sf).edges)).select("node", F.round("degree", 4).alias("degree"))


@query(f"{WITH} SELECT n.path, coalesce(degree, 0) AS degree, symbols FROM (SELECT path, count(*) AS symbols FROM nodes GROUP BY path) n LEFT JOIN (SELECT a.path, count(*) AS degree FROM (SELECT DISTINCT src, dst FROM edges) e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY a.path) d USING (path) ORDER BY degree DESC, path LIMIT 50")
def repo_map_hubs(spark, sf):
    g = graph(spark, sf)
    return A.hub_files(g.nodes, g.edges, 50)


@query(f"{WITH} SELECT DISTINCT path FROM nodes WHERE path NOT IN (SELECT b.path FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.path <> b.path)")
def orphan_files(spark, sf):
    g = graph(spark, sf)
    return A.orphan_files(g.nodes, g.edges)


@query(f"{WITH} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def unreferenced_nodes(spark, sf):
    g = graph(spark, sf)
    return g.nodes.select("id").join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")


_SPANS = "spans AS (SELECT event_type AS symbol, CAST(round(value * 1000) AS BIGINT) AS duration_us, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END AS status, CAST(ts AS DATE) AS day FROM events)"
_STATS = "count(*) AS n, count(*) FILTER (WHERE lower(status) = 'error') AS errors, sum(duration_us)::BIGINT AS total_us, min(duration_us) AS min_us, max(duration_us) AS max_us, quantile_disc(duration_us, 0.5) AS p50_us, quantile_disc(duration_us, 0.95) AS p95_us, quantile_disc(duration_us, 0.99) AS p99_us"


def _spans(spark, sf):
    e = _t(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.round(F.col("value") * 1000).cast("long").alias("duration_us"), F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("status"), F.to_date("ts").alias("day"))


@query(f"WITH {_SPANS} SELECT symbol, {_STATS} FROM spans GROUP BY symbol")
def span_stats(spark, sf):
    return A.span_stats(_spans(spark, sf), "symbol")


@query(f"WITH {_SPANS} SELECT symbol, CAST(day AS VARCHAR) AS day, {_STATS} FROM spans GROUP BY symbol, day")
def span_stats_by_day(spark, sf):
    return A.span_stats(_spans(spark, sf), "symbol", "day").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_SPANS} SELECT symbol, {_STATS} FROM spans WHERE symbol = 'purchase' GROUP BY symbol")
def latency_one(spark, sf):
    g = graph(spark, sf)
    g.more["spans"] = _spans(spark, sf)
    return run(g, "latency(purchase)")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_attribute(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("WITH w AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::BIGINT AS n FROM documents), s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM w) SELECT doc_id, source, used::BIGINT AS used FROM s WHERE used <= 5000")
def budget_prefix(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source", "text")
    return A.budget_prefix(d, F.col("text"), 5000, "doc_id", group="source").select("doc_id", "source", "used")


@query(f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, src, dst) AS r FROM edges) SELECT src, dst, kind FROM r WHERE r <= 5")
def policy_samples(spark, sf):
    return A.first_per_group(graph(spark, sf).edges, "kind", 5, F.desc("weight"), "src", "dst").select("src", "dst", "kind")


@query(f"{WITH}, m AS (SELECT DISTINCT split_part(path, '/', 1) AS module, path FROM nodes), c AS (SELECT module, regexp_extract(path, '^(.*)/[^/]*$', 1) AS label, count(*) AS n FROM m GROUP BY ALL) SELECT module, arg_min(label, (-n, label)) AS label FROM c GROUP BY module")
def module_labels(spark, sf):
    return A.label_mode(graph(spark, sf).nodes.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).distinct())


@query(f"{WITH}, r AS (SELECT path, n, row_number() OVER (ORDER BY n DESC, path) AS r FROM (SELECT path, count(*) AS n FROM nodes GROUP BY path)) SELECT path, n, (SELECT count(*) FROM r WHERE r > 19) AS over FROM r WHERE r <= 19")
def capped_modules(spark, sf):
    return A.capped(A.count_by(graph(spark, sf).nodes, "path"), 19, F.desc("n"), "path").select("path", "n", "over")


# Resolution
_REFS = """
defs AS (SELECT 5000000 + p_partkey AS id, CASE WHEN CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 < 25 ELSE p_size % 2 = 0 END THEN 'a' ELSE 'b' END AS repo_id, 'd/' || p_brand AS path, 'm::' || lower(split_part(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END)) || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 50 AS VARCHAR) ELSE '' END AS symbol FROM part),
names AS (SELECT id, repo_id, path, string_split(symbol, '::')[-1] AS name FROM defs),
refs AS (
  SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS repo_id, 'd/' || p_brand AS path, 5000000 + p_partkey AS src, lower(split_part(p_name, ' ', CASE WHEN p_partkey % 4 < 2 THEN 2 ELSE 1 END)) || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 50 AS VARCHAR) ELSE '' END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'INHERITS' ELSE 'CALL' END AS kind, p_partkey % 7 = 0 AS is_member FROM part)"""


def _refs(spark, sf):
    p = _t(spark, sf, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 50).cast("string")).otherwise("")
    word = lambda i: F.concat(F.lower(F.split_part("p_name", F.lit(" "), i)), tail)
    own = [F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("repo_id"), F.concat(F.lit("d/"), "p_brand").alias("path")]
    i = F.lit(5_000_000) + F.col("p_partkey")
    home = F.when(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 50 < 25).otherwise(F.col("p_size") % 2 == 0), "a").otherwise("b")
    defs = p.select(i.alias("id"), home.alias("repo_id"), own[1], F.concat(F.lit("m::"), word(F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(2))).alias("symbol"))
    refs = p.select(*own, i.alias("src"), word(F.when(F.col("p_partkey") % 4 < 2, 2).otherwise(1)).alias("name"), F.when(F.col("p_partkey") % 5 == 0, "INHERITS").otherwise("CALL").alias("kind"), (F.col("p_partkey") % 7 == 0).alias("is_member"))
    return defs, refs


_RESOLVED = f"""WITH {_REFS}, c AS (SELECT r.*, n.id AS dst, n.path = r.path AS here, count(*) OVER w AS n, sum((n.path = r.path)::INT) OVER w AS own FROM refs r JOIN names n USING (name) WINDOW w AS (PARTITION BY r.src, r.path, r.name, r.kind, r.is_member)),
  k AS (SELECT *, kind = 'CALL' AND NOT is_member AND own = 1 AS local FROM c),
  e AS (SELECT src, dst, CASE WHEN kind <> 'CALL' THEN kind WHEN local OR (n = 1 AND NOT is_member) THEN 'CALLS_EXACT' ELSE 'CALLS_DYNAMIC' END AS kind, CASE WHEN local THEN 'SAME_FILE_EXACT' WHEN n = 1 THEN 'UNIQUE_GLOBAL_EXACT' ELSE 'AMBIGUOUS_HEURISTIC' END AS resolution_kind FROM k WHERE NOT local OR here)"""


@query(f"{_RESOLVED} SELECT src, dst, kind, max(resolution_kind) AS resolution_kind FROM e GROUP BY ALL")
def resolve_refs(spark, sf):
    defs, refs = _refs(spark, sf)
    return RS.resolve_refs(refs, defs).select("src", "dst", "kind", "resolution_kind")


@query(f"{_RESOLVED}, u AS (SELECT src, dst, kind, max(resolution_kind) AS resolution_kind FROM e GROUP BY src, dst, kind) SELECT kind, resolution_kind, count(*) AS n FROM u GROUP BY kind, resolution_kind")
def resolve_class_counts(spark, sf):
    defs, refs = _refs(spark, sf)
    return RS.edge_counts(refs, defs)


@query(f"WITH {_REFS} SELECT DISTINCT repo_id, path, name AS short_name FROM refs WHERE name NOT IN (SELECT name FROM names)")
def unresolved_refs(spark, sf):
    defs, refs = _refs(spark, sf)
    return RS.unresolved(refs, defs)


@query(f"WITH {_REFS}, l AS (SELECT DISTINCT repo_id, src, name FROM refs r WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.name = r.name AND n.repo_id = r.repo_id)), c AS (SELECT l.src, n.id AS dst, count(*) OVER (PARTITION BY l.repo_id, l.src, l.name) AS n FROM l JOIN names n ON n.name = l.name AND n.repo_id <> l.repo_id) SELECT src, dst, CASE WHEN n = 1 THEN 'UNIQUE_GLOBAL_EXACT' ELSE 'AMBIGUOUS_HEURISTIC' END AS resolution_kind FROM c")
def cross_repo_refs(spark, sf):
    defs, refs = _refs(spark, sf)
    return RS.cross_repo(refs, defs).select("src", "dst", "resolution_kind")


@query(f"""WITH {_REFS}, ch AS (SELECT 'd/Brand#12' AS path), es AS (SELECT r.src, n.id AS dst FROM refs r JOIN names n USING (name)), old AS (SELECT * FROM names WHERE path IN (SELECT path FROM ch))
  SELECT path FROM ch UNION SELECT d.path FROM es JOIN defs d ON d.id = es.src WHERE es.dst IN (SELECT id FROM old) UNION SELECT path FROM refs WHERE name IN (SELECT name FROM old)""")
def affected_closure(spark, sf):
    defs, refs = _refs(spark, sf)
    changed = spark.createDataFrame([("d/Brand#12",)], "path string")
    into = RS.edges_into(refs, defs, defs.join(changed, "path", "left_semi"))
    return RS.affected_paths(defs, into, refs, changed)


# Mutation
@query("SELECT l_orderkey AS src, l_partkey AS dst, 'CONTAINS' AS kind, arg_max(l_quantity, (l_linenumber, l_quantity)) AS weight FROM lineitem GROUP BY ALL")
def upsert_edges_last_wins(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CONTAINS").alias("kind"), F.col("l_quantity").alias("weight"), "l_linenumber")
    return M.last_wins(rows, M.EDGE_KEY, "l_linenumber").drop("l_linenumber")


@query(f"""{WITH}, o AS (SELECT * FROM nodes WHERE kind = 'part'),
  n AS (SELECT repo_id, path, symbol, kind, line_start + CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END AS line_start, line_end + 3 AS line_end, CASE WHEN id % 3 = 0 THEN signature || ' v2' ELSE signature END AS signature FROM o),
  j AS (SELECT n.*, o.id FROM n LEFT JOIN o ON o.repo_id = n.repo_id AND o.path = n.path AND o.symbol = n.symbol AND o.kind = n.kind AND (o.signature = n.signature OR o.line_start = n.line_start))
  SELECT coalesce(id, (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY id IS NULL ORDER BY repo_id, path, symbol, kind, line_start)) AS id, symbol, line_start, signature FROM j""")
def upsert_nodes_identity(spark, sf):
    o = graph(spark, sf).nodes.filter("kind = 'part'")
    n = o.withColumns({"line_start": (F.col("line_start") + F.when(F.col("id") % 2 == 0, 3).otherwise(0)).cast("int"), "line_end": (F.col("line_end") + 3).cast("int"), "signature": F.when(F.col("id") % 3 == 0, F.concat("signature", F.lit(" v2"))).otherwise(F.col("signature"))})
    return M.merge_identity(o, n).select("id", "symbol", "line_start", "signature")


@query(f"{WITH}, g AS (SELECT id FROM nodes WHERE path = 'part/Brand#11') SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) GROUP BY kind")
def purge_file_bidirectional(spark, sf):
    g = graph(spark, sf)
    return A.count_by(M.purge_file_edges(g.nodes, g.edges, spark.createDataFrame([("part/Brand#11",)], "path string")), "kind")


@query(f"{WITH} SELECT count(*) AS n FROM nodes WHERE NOT (kind = 'customer' AND id NOT IN (SELECT dst FROM edges))")
def purge_orphans(spark, sf):
    g = graph(spark, sf)
    return M.purge_orphans(g.nodes, g.edges, "customer").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT DISTINCT a.path FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE b.path = 'part/Brand#11'")
def source_paths(spark, sf):
    g = graph(spark, sf)
    return M.source_paths_for_targets(g.nodes, g.edges, spark.createDataFrame([("part/Brand#11",)], "path string"))


# Gates
_RULES = [GT.Rule("disallow", "customer", "nation/1"), GT.Rule("disallow", "customer", "orders"), GT.Rule("require", "region", "orders"), GT.Rule("require", "orders", "part"), GT.Rule("disallow", "part", "supplier", ("ops",))]
_CROSS = "x AS (SELECT DISTINCT r.kind, r.f, r.t, e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst JOIN rules r ON (a.path = r.f OR starts_with(a.path, r.f || '/')) AND (b.path = r.t OR starts_with(b.path, r.t || '/'))), n AS (SELECT kind, f, t, count(*) AS n FROM x GROUP BY ALL)"
_RULES_SQL = "rules(kind, f, t) AS (VALUES ('disallow', 'customer', 'nation/1'), ('disallow', 'customer', 'orders'), ('require', 'region', 'orders'), ('require', 'orders', 'part'))"


@query(f'{WITH}, {_RULES_SQL}, {_CROSS} SELECT r.kind, r.f AS "from", r.t AS "to", coalesce(n, 0) AS n FROM rules r LEFT JOIN n USING (kind, f, t) WHERE CASE WHEN r.kind = \'disallow\' THEN coalesce(n, 0) > 0 ELSE coalesce(n, 0) = 0 END')
def policy_lint(spark, sf):
    g = graph(spark, sf)
    return GT.lint(g.nodes, g.edges, _RULES, roles=("ops",)).select("kind", "from", "to", "n")


@query(f"{WITH}, g AS (SELECT id FROM nodes WHERE symbol = 'nation::3') SELECT 'nation::3' AS symbol, symbol AS caller, path FROM nodes WHERE id IN (SELECT src FROM edges WHERE dst IN (SELECT id FROM g)) AND NOT (path = 'supplier' OR starts_with(path, 'supplier/')) AND symbol <> 'customer::1'")
def required_guards(spark, sf):
    g = graph(spark, sf)
    return GT.required_guards(g.nodes, g.edges, [{"symbol": "nation::3", "allow": ["customer::1"], "allow_globs": ["supplier/**"]}])


@query(f"WITH {_REFS} SELECT DISTINCT path, name AS short_name FROM refs WHERE name NOT IN (SELECT name FROM names) AND path <> 'd/Brand#11'")
def phantom_refs(spark, sf):
    defs, refs = _refs(spark, sf)
    return GT.phantom_symbols(RS.unresolved(refs, defs), exempt=("d/Brand#11",))


@query(f"{_AS_RS} SELECT DISTINCT 'part' AS module, a.symbol AS source, b.symbol AS target FROM edges e JOIN nodes a ON a.id = e.src JOIN rs b ON b.id = e.dst WHERE starts_with(b.path, 'part/') AND NOT starts_with(a.path, 'part/') AND NOT {_PUBLIC.replace('signature', 'b.signature')}")
def boundary_visibility(spark, sf):
    g = graph(spark, sf)
    both = _rs(spark, sf).unionByName(g.nodes.filter("kind = 'orders'"))
    return GT.encapsulation(both, g.edges, spark.createDataFrame([("part",)], "prefix string")).distinct()


_ENTRIES = f"{_AS_RS}, en AS (SELECT string_split(symbol, '::')[-1] AS symbol, kind AS entry_kind, trim(signature) AS signature, path, line_start AS line FROM rs WHERE {_PUBLIC}), en2 AS (SELECT symbol, entry_kind, CASE WHEN CAST(symbol AS INT) % 5 = 0 THEN signature || ' -> i32' ELSE signature END AS signature, path, line FROM en WHERE CAST(symbol AS INT) % 4 <> 0 UNION ALL SELECT 'x' || symbol, entry_kind, signature, path, line FROM en WHERE CAST(symbol AS INT) % 6 = 0)"


def _entries(spark, sf):
    a = GT.contract_entries(_rs(spark, sf))
    n = F.col("symbol").cast("int")
    b = a.filter(n % 4 != 0).withColumn("signature", F.when(n % 5 == 0, F.concat("signature", F.lit(" -> i32"))).otherwise(F.col("signature")))
    return a, b.unionByName(a.filter(n % 6 == 0).withColumn("symbol", F.concat(F.lit("x"), "symbol")))


@query(f"{_ENTRIES} SELECT * FROM en")
def contract_entries(spark, sf):
    return _entries(spark, sf)[0]


@query(f"{_ENTRIES} SELECT sha256(string_agg(entry_kind || ' ' || symbol || ' :: ' || signature || chr(10), '' ORDER BY entry_kind || ' ' || symbol || ' :: ' || signature)) AS hash FROM en")
def contract_hash(spark, sf):
    return GT.entries_hash(_entries(spark, sf)[0])


_DIFF = "df AS (SELECT symbol, CASE WHEN a.entry_kind IS NULL THEN 'added' WHEN b.entry_kind IS NULL THEN 'removed' WHEN a.signature <> b.signature THEN 'changed' END AS change FROM en a FULL JOIN en2 b USING (symbol))"


@query(f"{_ENTRIES}, {_DIFF} SELECT * FROM df WHERE change IS NOT NULL")
def contract_diff(spark, sf):
    return GT.contract_diff(*_entries(spark, sf)).select("symbol", "change")


@query(f"{_ENTRIES}, {_DIFF}, im AS (SELECT DISTINCT string_split(b.symbol, '::')[-1] AS symbol FROM edges e JOIN nodes b ON b.id = e.dst JOIN nodes a ON a.id = e.src WHERE b.kind = 'part' AND a.path = 'orders/1-URGENT') SELECT symbol, change, symbol IN (SELECT symbol FROM im) AND change <> 'added' AS in_scope FROM df WHERE change IS NOT NULL")
def contract_diff_scoped(spark, sf):
    g = graph(spark, sf)
    used = g.nodes.filter("path = 'orders/1-URGENT' OR kind = 'part'")
    return GT.scoped(GT.contract_diff(*_entries(spark, sf)), GT.imported_symbols(used, g.edges, "part")).select("symbol", "change", "in_scope")


@query(f"{WITH}, x AS (SELECT path, count(*) AS n, count(*) FILTER (WHERE line_start > 990) AS m FROM nodes GROUP BY path) SELECT path, CASE WHEN m > 0 THEN 'fail' WHEN n > 100 THEN 'incomplete' ELSE 'pass' END AS status FROM x")
def verdict_fold(spark, sf):
    x = graph(spark, sf).nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line_start") > 990).alias("m"))
    return x.select("path", GT.verdict_column(F.col("m"), F.when(F.col("n") > 100, 1).otherwise(0)).alias("status"))


# Notes, journal, history, documents
_NOTES = "notes AS (SELECT event_id AS id, 'part/' || 'x' || '#part::' || user_id AS moniker, CASE WHEN event_type IN ('view', 'click') THEN 'ephemeral' ELSE 'crystallized' END AS tier, CASE WHEN event_type IN ('view', 'click') THEN floor(epoch(ts))::BIGINT + 86400 END AS expires_at, floor(epoch(ts))::BIGINT AS created_at FROM events)"
_NOW = 1705276800


def _notes(spark, sf):
    e = _t(spark, sf, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    short = F.col("event_type").isin("view", "click")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("part/x#part::"), F.col("user_id").cast("string")).alias("moniker"), R.tier(F.when(short, "ephemeral").otherwise("decision")).alias("tier"), F.when(short, at + R.TTL_SECONDS).alias("expires_at"), at.alias("created_at"))


@query(f"WITH {_NOTES} SELECT id, tier FROM notes WHERE tier = 'crystallized' OR expires_at > {_NOW}")
def notes_recall(spark, sf):
    return R.recall(_notes(spark, sf), _NOW).select("id", "tier")


@query(f"WITH {_NOTES} SELECT id FROM notes WHERE tier = 'ephemeral' AND expires_at <= {_NOW}")
def notes_expired(spark, sf):
    return R.expired(_notes(spark, sf), _NOW).select("id")


@query(f"{WITH}, {_NOTES}, m AS (SELECT 'part/x#' || symbol AS moniker, min(id) AS nid FROM nodes WHERE kind = 'part' AND id % 2 = 0 GROUP BY ALL) SELECT notes.id, nid AS target_node_id, nid IS NULL AS stale FROM notes LEFT JOIN m USING (moniker)")
def notes_reattach(spark, sf):
    n = graph(spark, sf).nodes.filter("kind = 'part' AND id % 2 = 0").withColumn("path", F.lit("part/x"))
    notes = _notes(spark, sf).withColumns({"target_node_id": F.lit(None).cast("long"), "stale": F.lit(False)})
    return R.reattach(notes, n).select("id", "target_node_id", "stale")


@query("SELECT event_id AS id, floor(epoch(ts))::BIGINT AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def review_history_latest(spark, sf):
    return R.history(_notes(spark, sf).select("id", "created_at"), 20)


@query(f"{_BLAST.replace('e.src, d + 1', 'e.dst, d + 1').replace('e.dst = r.id', 'e.src = r.id').replace('d < 1', 'd < 8')} SELECT id, level FROM hit")
def journal_changed(spark, sf):
    g = graph(spark, sf)
    return R.journal(g.nodes, g.edges, _changed(spark))[1]


_GAP = 2
_SESS = f"e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL {_GAP} HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e)"


@query(f"WITH {_SESS} SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, b")
def debounce_sessions(spark, sf):
    from graphloft.streaming.debounce import batches

    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = batches(e, "ts", f"{_GAP} hours", "user_id", last=F.max("ts"), n=F.count(F.lit(1)))
    return b.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


@query(f"WITH {_SESS}, z AS (SELECT user_id, b, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS batches, count(*) FILTER (WHERE n >= 3) AS deferred FROM z GROUP BY user_id")
def debounce_gated(spark, sf):
    from graphloft.streaming.debounce import batches

    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return batches(e, "ts", f"{_GAP} hours", "user_id", n=F.count(F.lit(1))).groupBy("user_id").agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("n") >= 3).alias("deferred"))


# Text functions
@query("SELECT DISTINCT p_name, levenshtein(p_name, 'antique blush') AS distance FROM part ORDER BY distance, p_name LIMIT 5")
def suggest_levenshtein(spark, sf):
    return suggestions(_t(spark, sf, "part").select(F.col("p_name").alias("symbol")), "antique blush").select(F.col("symbol").alias("p_name"), "distance")


@query(r"""WITH n AS (SELECT DISTINCT replace(initcap_name, ' ', '') || 'HTTPServer_' || p_size AS name FROM (SELECT p_size, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS initcap_name FROM part))
  SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(translate(name, '_-', '  '), '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '\s+', ' ', 'g')) AS words FROM n""")
def split_identifiers(spark, sf):
    p = _t(spark, sf, "part")
    name = F.concat(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), ""), F.lit("HTTPServer_"), F.col("p_size").cast("string"))
    return p.select(name.alias("name")).distinct().select("name", X.split_identifier(F.col("name")).alias("words"))


@query("SELECT symbol, CASE WHEN contains(symbol, '::') THEN string_split(symbol, '::')[-1] ELSE symbol END AS short, regexp_extract(symbol, '([^:.]*)$', 1) AS contract_short, 'p/q#' || symbol AS moniker, 'r::p/q::' || symbol AS composite FROM (SELECT DISTINCT replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '::' ELSE '.' END) AS symbol FROM part)")
def name_functions(spark, sf):
    s = F.regexp_replace("p_name", " ", F.when(F.col("p_size") % 2 == 0, "::").otherwise("."))
    d = _t(spark, sf, "part").select(s.alias("symbol")).distinct()
    c = F.col("symbol")
    return d.select("symbol", X.short_name(c).alias("short"), contract_short_name(c).alias("contract_short"), X.moniker(F.lit("p/q"), c).alias("moniker"), X.composite_key(F.lit("r"), F.lit("p/q"), c).alias("composite"))


_TERMS = r"post AS (SELECT doc_id AS id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY ALL)"


@query(f"""WITH {_TERMS}, ln AS (SELECT id, sum(tf) AS len FROM post GROUP BY id), av AS (SELECT avg(len) AS m FROM ln), q AS (SELECT unnest(['token', 'the']) AS term),
  g AS (SELECT unnest(['auth', 'authentication', 'login', 'jwt', 'token', 'credential']) AS term, 0 AS g UNION ALL SELECT 'the', 1),
  df AS (SELECT term, count(DISTINCT id) AS df FROM post WHERE term IN (SELECT term FROM g) GROUP BY term),
  s AS (SELECT p.id, sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT m FROM av)))) AS score, count(DISTINCT g.g) AS k FROM post p JOIN g USING (term) JOIN df USING (term) JOIN ln USING (id) GROUP BY p.id)
  SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s WHERE k = 2 QUALIFY rank <= 20""")
def bm25_topk(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    posts = S.postings(rows, ("body",), stemmed=False)
    return S.bm25(posts, rows, "token the", 20, stemmed=False).select("id", "rank")


@query(f"WITH {_TERMS} SELECT id FROM post WHERE term IN ('und', 'sich') GROUP BY id HAVING count(*) = 2")
def find_all_hits(spark, sf):
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return S.find_all(S.postings(rows, ("body",), stemmed=False), rows, "und Sich", stemmed=False).select("id")


_VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE id = 0)"


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _q(spark, sf):
    return list(_vectors(spark, sf).filter("id = 0").first()["v"])


@query(f"WITH {_VEC} SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(v, q), 6) DESC, id)::INT AS rank FROM v, q QUALIFY rank <= 10")
def vector_topk_exact(spark, sf):
    return S.vector_topk(_vectors(spark, sf), _q(spark, sf), 10).select("id", "rank")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT q.id AS query, v.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(v.v, q.v), 6) DESC, v.id)::INT AS rank FROM v, v q WHERE q.id % 20 = 0 QUALIFY rank <= 10""")
def vector_two_stage(spark, sf):
    v = _vectors(spark, sf)
    return S.vector_topk_each(v, v.filter("id % 20 = 0"), 10).select("query", "id", "rank")


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.4")
def similar_pairs(spark, sf):
    return S.similar_pairs(_vectors(spark, sf), 0.4).select("a", "b")


_LISTS = "l AS (SELECT 'x' AS list, doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank0 FROM documents QUALIFY rank0 < 50 UNION ALL SELECT 'y', doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS rank0 FROM documents QUALIFY rank0 < 300)"


@query(f"WITH {_LISTS}, s AS (SELECT id, round(sum(1.0 / (60 + rank0 + 1)), 9) AS score FROM l GROUP BY id) SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 20")
def rrf_fusion(spark, sf):
    from pyspark.sql import Window

    d = _t(spark, sf, "documents")
    rank = lambda name, n, *o: d.select(F.lit(name).alias("list"), F.col("doc_id").alias("id"), (F.row_number().over(Window.partitionBy().orderBy(*o)) - 1).alias("rank0")).filter(F.col("rank0") < n)
    return S.rrf(rank("x", 50, F.desc("n_chars"), "doc_id").unionByName(rank("y", 300, F.desc("doc_id"))), 20).select("id", "rank")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, 'g' || label || '/' || (vec_id % 7) AS path FROM embeddings),
  p AS (SELECT least(a.path, b.path) AS a, greatest(a.path, b.path) AS b, max(round(list_cosine_similarity(a.v, b.v), 6)) AS sim FROM v a JOIN v b ON a.id < b.id WHERE a.path <> b.path AND a.path <> 'g1/0' AND b.path <> 'g1/0' AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.5 GROUP BY ALL),
  e AS (SELECT DISTINCT least(a.path, b.path) AS a, greatest(a.path, b.path) AS b FROM v a JOIN v b ON b.id = a.id + 1)
  SELECT a, b FROM p WHERE (a, b) NOT IN (SELECT (a, b) FROM e)""")
def semantic_coupling(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(F.lit("g"), F.col("label").cast("string"), F.lit("/"), (F.col("vec_id") % 7).cast("string")).alias("path"))
    e = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return S.coupling(v, e, S.similar_pairs(v.select("id", "v"), 0.5), "", 0.5, ("g1/0",)).select("a", "b")


# Markup
@query(r"""SELECT page_id, u.pos::INT AS pos, u.href FROM (SELECT page_id, unnest(list_transform(list_zip(range(len(h)), h), lambda p: {'pos': p[1], 'href': p[2]})) AS u FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS h FROM pages))""", name="page_links")
def _page_links(spark, sf):
    return page_links(_t(spark, sf, "pages"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<script'))::BIGINT AS scripts, len(regexp_extract_all(html, '<script[^>]*\ssrc="([^"]*)"', 1))::BIGINT AS sources FROM pages""", name="page_scripts")
def _page_scripts(spark, sf):
    return page_scripts(_t(spark, sf, "pages"))


@query(r"""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '\sclass="([^"]+)"', 1))) AS symbol FROM pages""", name="page_classes")
def _page_classes(spark, sf):
    return page_classes(_t(spark, sf, "pages"))


# Analytics
_RING = "re AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)"


def _ring(spark, sf):
    item = _t(spark, sf, "lineitem")
    a = item.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("src"))
    e = a.join(item.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dst")), ["l_orderkey", "l_linenumber"]).filter("src <> dst").select("src", "dst").distinct()
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), e


@query(f"WITH RECURSIVE {_RING}, r(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.a, e.dst FROM r JOIN re e ON e.src = r.b) SELECT x.a AS id, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def scc_members(spark, sf):
    return strong_components(*_ring(spark, sf))


@query(f"{REC}, r(id, l) AS (SELECT id, 0 FROM nodes UNION SELECT e.dst, l + 1 FROM r JOIN edges e ON e.src = r.id) SELECT id, max(l)::INT AS level FROM r GROUP BY id")
def topo_levels(spark, sf):
    g = graph(spark, sf)
    return topological_levels(g.nodes, g.edges)


@query()
def file_modules(spark, sf):
    from graphloft.operators.analytics import file_modules as modules

    g = graph(spark, sf)
    return modules(g.nodes, g.edges)


@query()
def file_rings(spark, sf):
    from graphloft.operators.analytics import file_rings as rings

    n, e = _ring(spark, sf)
    return rings(n.withColumn("path", F.concat(F.lit("s/"), F.col("id").cast("string"))), e)


# Federation
@query(f"""{_RESOLVED}, key AS (SELECT id, repo_id, repo_id || '::' || path || '::' || symbol AS key FROM defs), l AS (SELECT DISTINCT repo_id, src, name FROM refs r WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.name = r.name AND n.repo_id = r.repo_id)),
  x AS (SELECT l.src, n.id AS dst, 'CROSS_REPO' AS kind FROM l JOIN names n ON n.name = l.name AND n.repo_id <> l.repo_id UNION SELECT src, dst, 'LOCAL' FROM e)
  SELECT DISTINCT a.key AS source, b.key AS target, x.kind FROM x JOIN key a ON a.id = x.src JOIN key b ON b.id = x.dst""")
def composite_federation(spark, sf):
    defs, refs = _refs(spark, sf)
    return FED.compose(defs, None, refs)[1].select("source", "target", "kind").distinct()


@query(f"WITH {_REFS} SELECT name, repo_id, count(DISTINCT src) AS users FROM refs WHERE repo_id = 'b' AND name IN (SELECT name FROM names WHERE repo_id = 'a') GROUP BY ALL")
def migration_affected(spark, sf):
    defs, refs = _refs(spark, sf)
    own = RS.targets(defs).filter("dst_repo = 'a'").select("name").distinct()
    return refs.filter("repo_id = 'b'").join(own, "name", "left_semi").groupBy("name", "repo_id").agg(F.countDistinct("src").alias("users"))


_ASKED = ("Who uses `{}` today?", "Tell me what does `{}` call", "What breaks without `{}`?", "List everything that depends on `{}`")


@query(f"""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 1 THEN 'callees' WHEN 2 THEN 'impact' ELSE 'callers' END AS verb, n_name AS symbol FROM nation""")
def nl_route_prompts(spark, sf):
    from graphloft.plans.router import route

    rows = _t(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # a fixed table of 25 rows
    names = sorted(r["n_name"] for r in rows)
    return spark.createDataFrame([(r["n_nationkey"], *route(_ASKED[r["n_nationkey"] % 4].format(r["n_name"]), names)[:2]) for r in rows], "id int, verb string, symbol string")


@query(f"{WITH}, c AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, turn AS src, nxt AS dst FROM c WHERE nxt IS NOT NULL")
def conversation_chain(spark, sf):
    from pyspark.sql import Window

    c = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("dst"))
    return c.filter("dst IS NOT NULL")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What one customer's orders lead to, by kind."""
    return A.count_by(run(graph(spark, sf), "impact(customer::7)"), "kind")


QUERIES["impact_by_kind"] = flagship
ORACLE["impact_by_kind"] = f"{_FORWARD} SELECT n.kind, count(*) AS n FROM r JOIN nodes n USING (id) WHERE id <> {CUSTOMER} GROUP BY n.kind"

from graphloft.plans import more  # noqa: E402, F401  registers the rest
