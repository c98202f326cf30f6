"""Registered queries for stores, records, sources and composites, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloft.api import Engine
from graphloft.functions import text as X
from graphloft.operators import federation as FED
from graphloft.operators import filters as FL
from graphloft.operators import gates as GT
from graphloft.operators import mutation as M
from graphloft.operators import records as R
from graphloft.operators import resolve as RS
from graphloft.operators import traverse as T
from graphloft.plans import registry as Q
from graphloft.plans.query import resolve_symbol
from graphloft.plans.registry import CUSTOMER, SUPPLIER, WITH, query
from graphloft.plans.samples import SOURCES
from graphloft.sources import files, ignore, otlp, repository
from graphloft.sources.projection import graph


# Point reads and filters
@query(f"{WITH} SELECT id, symbol, path, kind FROM nodes WHERE id = {CUSTOMER}")
def node_by_id(spark, sf):
    return Engine(graph(spark, sf)).get_node(CUSTOMER).select("id", "symbol", "path", "kind")


@query(f"{WITH} SELECT min(id) AS id FROM nodes WHERE symbol = 'part::7'")
def resolve_symbol_id(spark, sf):
    return spark.createDataFrame([(resolve_symbol(graph(spark, sf).nodes, "PART::7"),)], "id long")


def _named(spark, sf):
    """Nodes whose paths have the endings of several languages."""
    n = graph(spark, sf).nodes
    end = F.when(F.col("kind") == "part", ".rs").when(F.col("kind") == "supplier", ".hpp").when(F.col("kind") == "nation", ".TS").when(F.col("kind") == "region", ".cc").otherwise("")
    return n.withColumn("path", F.concat("path", end))


_NAMED = f"{WITH}, nm AS (SELECT *  REPLACE (path || CASE kind WHEN 'part' THEN '.rs' WHEN 'supplier' THEN '.hpp' WHEN 'nation' THEN '.TS' WHEN 'region' THEN '.cc' ELSE '' END AS path) FROM nodes)"


@query(f"{_NAMED} SELECT id, path FROM nm WHERE ends_with(path, '.rs') AND kind = 'part' AND NOT starts_with(path, 'part/Brand#1')")
def filter_language(spark, sf):
    return _named(spark, sf).filter(FL.NodeFilter(lang="Rust", path_exclude="part/Brand#1").condition()).select("id", "path")


@query(f"{_NAMED} SELECT id, path FROM nm WHERE ends_with(path, '.hpp') OR ends_with(path, '.cc')")
def filter_search_language(spark, sf):
    return _named(spark, sf).filter(FL.has_language(F.col("path"), "CPP")).select("id", "path")


@query(f"{WITH} SELECT id, contains(lower(symbol), 'brand#1') OR contains(lower(path), 'brand#1') AS direct FROM nodes")
def direct_matches(spark, sf):
    return graph(spark, sf).nodes.select("id", FL.direct_match(F.col("symbol"), F.col("path"), "Brand#1").alias("direct"))


@query(f"{WITH}, v AS (SELECT id, path FROM nodes WHERE kind IN ('part', 'supplier')) SELECT path, count(*) AS n FROM v GROUP BY path")
def masked_files(spark, sf):
    g = graph(spark, sf)
    seen, _ = FL.drop_hidden(g.nodes, g.edges, F.col("kind").isin("part", "supplier"))
    return seen.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# Traversal and composites
@query(f"{Q._LEVELS.format(rec=Q.REC, seed=CUSTOMER, of='src', to='dst', k=2)}, b(id, d) AS (SELECT {CUSTOMER}::BIGINT, 0 UNION ALL SELECT DISTINCT e.src, d + 1 FROM b JOIN edges e ON e.dst = b.id WHERE d < 2) SELECT 'outgoing' AS direction, id, min(d)::INT AS level FROM r WHERE id <> {CUSTOMER} GROUP BY id UNION ALL SELECT 'incoming', id, min(d)::INT FROM b WHERE id <> {CUSTOMER} GROUP BY id")
def call_trace(spark, sf):
    g = graph(spark, sf)
    return T.call_trace(g.nodes, g.edges, CUSTOMER, 2).select("direction", "id", "level")


@query(f"{Q._FORWARD}, o(id) AS (SELECT {CUSTOMER + 1}::BIGINT UNION SELECT e.dst FROM o JOIN edges e ON e.src = o.id) SELECT id FROM r INTERSECT SELECT id FROM o")
def reach_in_common(spark, sf):
    g = graph(spark, sf)
    return T.in_common(*[T.reachable_within(g.edges, Q._seed(spark, CUSTOMER + i)) for i in (0, 1)])


@query(f"{Q.REC}, {Q._CHANGED}, r(id) AS (SELECT id FROM nodes WHERE path IN (SELECT path FROM ch) UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.id) SELECT count(*) AS n, count(*) >= 200 AS waits FROM r")
def radius_gate(spark, sf):
    g = graph(spark, sf)
    return spark.createDataFrame([T.radius_gate(g.nodes, g.edges, Q._changed(spark))], "n long, waits boolean")


@query(f"{Q._FORWARD} SELECT regexp_extract(path, '^(.*)/', 1) || ' ' || count(*) AS line FROM r JOIN nodes USING (id) WHERE id <> {CUSTOMER} GROUP BY regexp_extract(path, '^(.*)/', 1)")
def impact_folders(spark, sf):
    name, tier = Engine(graph(spark, sf)).impact_tiers("customer::7", 1)
    assert name == "folders"
    return tier


@query(f"{WITH} SELECT DISTINCT src, dst FROM edges")
def adjacency(spark, sf):
    g = graph(spark, sf)
    return T.adjacency(g.nodes, g.edges)


@query(f"{WITH} SELECT id, row_number() OVER (ORDER BY line_start, line_end, symbol, id)::INT AS pos FROM nodes WHERE path = 'supplier/3'")
def file_outline(spark, sf):
    g = graph(spark, sf)
    cards = Engine(g).file_api("supplier/3").select("symbol", "pos")
    return cards.join(g.nodes.select("id", "symbol"), "symbol").select("id", "pos")


# Writes
_GONE = "gone AS (SELECT 'part/Brand#11' AS path UNION ALL SELECT 'supplier/3')"


@query(f"{WITH}, {_GONE} SELECT kind, count(*) AS n FROM nodes WHERE path NOT IN (SELECT path FROM gone) GROUP BY kind")
def purge_file_nodes(spark, sf):
    return M.purge_file_nodes(graph(spark, sf).nodes, Q._changed(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, {_GONE} SELECT kind, count(*) AS n FROM nodes WHERE path NOT IN (SELECT path FROM gone) OR id % 2 = 0 GROUP BY kind")
def purge_file_nodes_except(spark, sf):
    n = graph(spark, sf).nodes
    return M.purge_file_nodes(n, Q._changed(spark), n.filter("id % 2 = 0")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, {_GONE}, left_ AS (SELECT id FROM nodes WHERE path NOT IN (SELECT path FROM gone)) SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM left_) OR dst NOT IN (SELECT id FROM left_) GROUP BY kind")
def dangling_edges(spark, sf):
    g = graph(spark, sf)
    return M.dangling(M.purge_file_nodes(g.nodes, Q._changed(spark)), g.edges).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, {_GONE} SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE path IN (SELECT path FROM gone)) GROUP BY kind")
def purge_outbound(spark, sf):
    g = graph(spark, sf)
    return M.purge_outbound(g.nodes, g.edges, Q._changed(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS qty FROM lineitem GROUP BY ALL")
def insert_last_wins(spark, sf):
    """New rows over old ones: the last line of each pair stays."""
    item = Q._t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("qty"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    old = M.last_wins(item.filter("at % 2 = 0"), ("src", "dst"), "at")
    new = M.last_wins(item, ("src", "dst"), "at")
    return M.upsert(old, new, ("src", "dst")).select("src", "dst", "qty")


_OPEN = f"WITH {Q._REFS}, u AS (SELECT DISTINCT repo_id, path, name AS short_name FROM refs WHERE name NOT IN (SELECT name FROM names))"


@query(f"{_OPEN} SELECT * FROM u WHERE path <> 'd/Brand#12' UNION SELECT repo_id, path, short_name || 'x' FROM u WHERE path = 'd/Brand#12'")
def put_unresolved(spark, sf):
    defs, refs = Q._refs(spark, sf)
    old = RS.unresolved(refs, defs)
    fresh = old.filter("path = 'd/Brand#12'").withColumn("short_name", F.concat("short_name", F.lit("x")))
    return RS.put_unresolved(old, spark.createDataFrame([("d/Brand#12",)], "path string"), fresh)


@query(f"{_OPEN} SELECT DISTINCT path FROM u WHERE short_name IN (SELECT min(short_name) FROM u UNION SELECT max(short_name) FROM u)")
def waiting_for_names(spark, sf):
    defs, refs = Q._refs(spark, sf)
    known = RS.unresolved(refs, defs)
    names = known.agg(F.min("short_name").alias("name")).union(known.agg(F.max("short_name")))
    return RS.waiting_for(names, known)


# Notes, spans, links, reviews, contracts
_NOTE0 = "SELECT event_id AS id, CAST(NULL AS BIGINT) AS target_node_id, 'm' || user_id AS moniker, 'crystallized' AS tier, CAST(NULL AS BIGINT) AS expires_at FROM events"


@query(f"{WITH}, o AS ({_NOTE0}), p AS (SELECT id AS target_node_id, path || '#' || symbol AS moniker, CASE WHEN id % 2 = 0 THEN 'ephemeral' ELSE 'crystallized' END AS tier, CASE WHEN id % 2 = 0 THEN 1086400::BIGINT END AS expires_at FROM nodes WHERE kind IN ('nation', 'supplier')) SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY moniker), * FROM p")
def pin_notes(spark, sf):
    n, none = graph(spark, sf).nodes, F.lit(None)
    old = Q._t(spark, sf, "events").select(F.col("event_id").alias("id"), none.cast("long").alias("target_node_id"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("moniker"), F.lit("crystallized").alias("tier"), none.cast("long").alias("expires_at"), F.lit("x").alias("content"))
    pins = n.filter(F.col("kind").isin("nation", "supplier")).select("path", "symbol", F.when(F.col("id") % 2 == 0, "ephemeral").otherwise("lasting").alias("tier"), F.lit("see").alias("content"))
    unknown = spark.createDataFrame([("nowhere", "nothing", "ephemeral", "see")], pins.schema)
    return R.pin(old, pins.unionByName(unknown), n, 1_000_000).drop("content")


_TRACE = "s AS (SELECT 't' || user_id AS trace_id, 's' || event_id AS span_id, event_type AS symbol, epoch_us(ts) AS start_us, CAST(round(value * 1000) AS BIGINT) AS duration_us, event_id FROM events)"


def _trace(spark, sf):
    e = Q._t(spark, sf, "events")
    return e.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"), F.col("event_type").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), F.round(F.col("value") * 1000).cast("long").alias("duration_us"), "event_id")


@query(f"WITH {_TRACE} SELECT trace_id, span_id, start_us, CASE WHEN event_id % 3 = 0 THEN duration_us + 1 ELSE duration_us END AS duration_us FROM s WHERE symbol = 'click'")
def put_and_scan_spans(spark, sf):
    s = _trace(spark, sf)
    old, new = s.drop("event_id"), s.filter("event_id % 3 = 0").withColumn("duration_us", F.col("duration_us") + 1).drop("event_id")
    return R.spans_of(R.put_spans(old, new), "click").drop("symbol")


@query(f"""{WITH}, s AS (SELECT event_id, 'part::' || user_id AS name, CASE WHEN event_id % 3 = 0 THEN 'supplier::' || (user_id % 500) END AS code_function FROM events)
  SELECT event_id, coalesce(a.symbol, b.symbol) AS symbol FROM s LEFT JOIN (SELECT DISTINCT symbol FROM nodes) a ON a.symbol = code_function LEFT JOIN (SELECT DISTINCT symbol FROM nodes) b ON b.symbol = name""")
def spans_to_symbols(spark, sf):
    user = F.col("user_id").cast("string")
    s = Q._t(spark, sf, "events").select("event_id", F.concat(F.lit("part::"), user).alias("name"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("supplier::"), (F.col("user_id") % 500).cast("string"))).alias("code_function"))
    return R.attach_spans(s, graph(spark, sf).nodes).select("event_id", "symbol")


@query("SELECT 't' || user_id AS trace_id, 's' || event_id AS span_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 's' || (event_id - 1) END AS parent_span_id, 'shop' AS service, event_type AS name, CASE WHEN event_id % 4 = 0 THEN 'm::f' END AS code_function, epoch_us(ts) AS start_us, greatest(event_id % 7 - 1, 0) AS duration_us, CASE event_id % 3 WHEN 0 THEN 'Error' WHEN 1 THEN 'Ok' ELSE 'Unset' END AS status FROM events")
def otlp_spans(spark, sf):
    """Trace exports made of events, one document for each, read back as span rows."""
    e, text = Q._t(spark, sf, "events"), lambda c: F.col(c).cast("string")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 37
    value = lambda v: F.struct(v.alias("stringValue"))
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), value(v).alias("value"))
    span = F.struct(
        F.concat(F.lit("t"), text("user_id")).alias("traceId"), F.concat(F.lit("s"), text("event_id")).alias("spanId"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("event_id") - 1).cast("string"))).alias("parentSpanId"), F.col("event_type").alias("name"),
        start.cast("string").alias("startTimeUnixNano"), (start + (F.col("event_id") % 7 - 1) * 1000).cast("string").alias("endTimeUnixNano"),
        F.when(F.col("event_id") % 4 == 0, F.array(attribute("code.function", F.lit("m::f")))).otherwise(F.array(attribute("other", F.lit("x")))).alias("attributes"),
        F.struct(F.element_at(F.array(F.lit("STATUS_CODE_ERROR"), F.lit("1"), F.lit("0")), (F.col("event_id") % 3 + 1).cast("int")).alias("code")).alias("status"),
    )
    doc = F.struct(F.array(F.struct(F.struct(F.array(attribute("service.name", F.lit("shop"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return otlp.spans(e.select(F.to_json(doc).alias("text")))


@query(f"""{WITH}, k AS (SELECT l_orderkey AS doc_id, 's' || l_linenumber AS section, {Q.OFFSET['supplier']} + l_suppkey AS target_node_id, CASE WHEN l_linenumber % 2 = 0 THEN 'sig' || l_linenumber END AS sig FROM lineitem)
  SELECT d.symbol AS doc, t.symbol AS target, section, coalesce(sig, 'new') AS provenance_signature FROM k LEFT JOIN nodes d ON d.id = k.doc_id + {Q.OFFSET['orders']} LEFT JOIN nodes t ON t.id = target_node_id WHERE sig IS NOT NULL OR k.doc_id % 3 = 0""")
def signed_doc_links(spark, sf):
    item = Q._t(spark, sf, "lineitem")
    old = item.select(
        (F.col("l_orderkey") + F.lit(Q.OFFSET["orders"])).alias("doc_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("section"), (F.col("l_suppkey") + F.lit(Q.OFFSET["supplier"])).alias("target_node_id"),
        F.lit("LINKS_TO").alias("kind"), F.lit("c").alias("provenance_commit"), F.lit("h").alias("provenance_hash"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("sig"), F.col("l_linenumber").cast("string"))).alias("provenance_signature"), "l_orderkey",
    )
    new = old.filter("l_orderkey % 3 = 0 AND provenance_signature IS NULL").withColumn("provenance_signature", F.lit("new"))
    return R.signed_links(R.put_doc_links(old.drop("l_orderkey"), new.drop("l_orderkey")), graph(spark, sf).nodes).select("doc", "target", "section", "provenance_signature")


_LINKS = "k AS (SELECT doc_id, source AS section, CASE WHEN doc_id % 3 = 0 THEN doc_id % 150 END AS link, CASE WHEN doc_id % 3 = 1 THEN doc_id % 30 END AS code FROM documents)"


@query(f"""{WITH}, {_LINKS} SELECT DISTINCT doc_id, section, s_suppkey + {Q.OFFSET['supplier']} AS target, 'LINKS_TO' AS kind FROM k JOIN supplier ON s_suppkey = link
  UNION SELECT DISTINCT doc_id, section, n.id, 'EXPLAINS_RATIONALE' FROM k JOIN nodes n ON n.symbol = 'nation::' || code WHERE doc_id % 2 = 0
  UNION SELECT DISTINCT doc_id, section, n.id, 'EXPLAINS_RATIONALE' FROM k JOIN nodes n ON n.symbol = 'nation::' || code WHERE doc_id % 2 = 1""")
def doc_links(spark, sf):
    """Wiki links by title in any case, code references by full name, and by short name in the reference's own folder."""
    d = Q._t(spark, sf, "documents")
    number = lambda n: (F.col("doc_id") % n).cast("string")
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("SUPPLIER No "), number(150), F.when(F.col("doc_id") % 2 == 0, "|shown").otherwise("#part")))
    code = F.when(F.col("doc_id") % 3 == 1, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" nation."), number(30), F.lit("() "))).otherwise(number(30)))
    docs = d.select("doc_id", F.lit("nation/x.md").alias("path"), F.col("source").alias("section"), link.alias("link"), code.alias("code"))
    notes = Q._t(spark, sf, "supplier").select((F.col("s_suppkey") + F.lit(Q.OFFSET["supplier"])).alias("id"), F.concat(F.lit("notes/supplier no "), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"))
    return R.doc_edges(docs, notes, graph(spark, sf).nodes)


@query("WITH r AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS created_at, 'b' || event_id AS base FROM events), n AS (SELECT o_orderkey, o_custkey FROM orders), f AS (SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY 4000000000 + o_custkey, 'o' || o_orderkey) AS id, 4000000000 + o_custkey AS created_at, 'o' || o_orderkey AS base FROM n) SELECT id, base, created_at FROM (SELECT * FROM r UNION ALL SELECT * FROM f) ORDER BY created_at DESC, id DESC LIMIT 60")
def append_reviews(spark, sf):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    old = Q._t(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("base"), F.lit("h").alias("head"), at.alias("created_at"))
    new = Q._t(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("base"), F.lit("h").alias("head"), (F.lit(4_000_000_000) + F.col("o_custkey")).alias("created_at"))
    return R.history(R.append_review(old, new), 60).drop("head")


@query("WITH c AS (SELECT 'a' || p_size % 3 AS service_a, 'b' || p_size % 2 AS service_b, p_name || p_partkey AS symbol, p_partkey FROM part) SELECT symbol, CASE WHEN p_partkey % 2 = 0 THEN 'v2' END AS signature FROM c WHERE service_a = 'a1' AND service_b = 'b1' AND p_partkey % 2 = 0")
def contract_records(spark, sf):
    """A newer record of a pair of services stands for the older one."""
    p = Q._t(spark, sf, "part")
    c = p.select(F.concat(F.lit("a"), (F.col("p_size") % 3).cast("string")).alias("service_a"), F.concat(F.lit("b"), (F.col("p_size") % 2).cast("string")).alias("service_b"), F.lit("http").alias("protocol"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("symbol"), F.lit("v1").alias("signature"), "p_partkey")
    new = c.filter("p_partkey % 2 = 0").withColumn("signature", F.lit("v2"))
    return GT.contract_between(GT.put_contracts(c, new), "a1", "b1").select("symbol", "signature")


@query("""WITH m AS (SELECT p_partkey, p_name FROM part) SELECT 'adr/' || p_partkey || '.md' AS path, 1 AS line, 'The ' || p_name || ' must not break' AS text FROM m UNION ALL SELECT 'adr/' || p_partkey || '.md', 6, 'it MUST never be ' || p_name FROM m""")
def adr_duties(spark, sf):
    """Lines that oblige, outside code fences."""
    name = F.col("p_name")
    text = F.concat(F.lit("The "), name, F.lit(" must not break\n```\ncode must stay as it is\n  ```\nplain "), name, F.lit("\n  it MUST never be "), name, F.lit("\nmusty end"))
    texts = Q._t(spark, sf, "part").select(F.concat(F.lit("adr/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    return R.adr_rules(texts)


# Federation
@query("SELECT 'disallow' AS kind, 'seg/' || c_mktsegment AS \"from\", 'nation/' || c_nationkey AS \"to\", max(c_custkey) AS n FROM customer GROUP BY ALL")
def peer_violations(spark, sf):
    c = Q._t(spark, sf, "customer")
    return FED.dedupe_violations(c.select(F.lit("disallow").alias("kind"), F.concat(F.lit("seg/"), "c_mktsegment").alias("from"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("to"), F.col("c_custkey").cast("long").alias("n")))


@query(f"""WITH {Q._REFS}, u AS (SELECT name, min(repo_id) AS provider FROM names GROUP BY name HAVING count(DISTINCT repo_id) = 1), s AS (SELECT min(name) AS name FROM u)
  SELECT s.name, provider, (SELECT count(DISTINCT repo_id) FROM refs r WHERE r.name = s.name AND repo_id <> provider) AS affected FROM s JOIN u USING (name)""")
def migration_survey(spark, sf):
    defs, refs = Q._refs(spark, sf)
    one = RS.targets(defs).groupBy("name").agg(F.countDistinct("dst_repo").alias("n")).filter("n = 1").agg(F.min("name")).first()[0]
    plan = FED.survey(defs, refs, one)
    return spark.createDataFrame([(one, plan["provider"], len(plan["affected"]))], "name string, provider string, affected long")


# Text, ignore files, repository listings
@query(r"""SELECT DISTINCT p, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, replace(regexp_replace(trim(c), '\(\)$', ''), '.', '::') AS ref, s || ' ' || p || ' :: ' || trim(c) AS line
  FROM (SELECT replace(p_name, ' ', '/') || CASE WHEN p_size % 3 = 0 THEN '.tar.gz' WHEN p_size % 3 = 1 THEN '' ELSE '.md' END AS p, ' ' || replace(p_name, ' ', '.') || '() ' AS c, p_brand AS s FROM part)""")
def path_functions(spark, sf):
    end = F.when(F.col("p_size") % 3 == 0, ".tar.gz").when(F.col("p_size") % 3 == 1, "").otherwise(".md")
    a = Q._t(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), end).alias("p"), F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("() ")).alias("c"), F.col("p_brand").alias("s"))
    p, c = F.col("p"), F.col("c")
    return a.select("p", X.stem_of(p).alias("stem"), X.dir_of(p).alias("dir"), X.code_ref(c).alias("ref"), X.canonical_line(F.col("s"), p, c).alias("line")).distinct()


_IGNORE = (("", "*.log\n# a note\n/src/Brand#11/\nBrand#2?/*.rs\n!keep.rs\ndeep/**/x.py\nbuild/\n"), ("src/Brand#33", "*.rs\n!1*.rs\n"))


@query(r"""WITH f AS (SELECT 'src/' || p_brand || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.log' WHEN 2 THEN '/build' ELSE '/build/a.rs' END AS path, p_brand, p_partkey FROM part)
  SELECT path FROM f WHERE NOT (p_partkey % 4 = 1 OR p_brand = 'Brand#11' OR p_partkey % 4 = 3 OR (p_brand LIKE 'Brand#2_' AND ends_with(path, '.rs') AND false) OR (p_brand = 'Brand#33' AND p_partkey % 4 = 0 AND NOT starts_with(CAST(p_partkey AS VARCHAR), '1')))""")
def ignored_files(spark, sf):
    """Paths that ignore files leave: patterns by name and by place, folders, a deeper file that takes back."""
    n = F.col("p_partkey") % 4
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.when(n == 0, ".rs").when(n == 1, ".log").when(n == 2, "/build").otherwise("/build/a.rs"))
    known = [r for base, text in _IGNORE for r in ignore.rules(base, text)]
    return Q._t(spark, sf, "part").select(path.alias("path")).filter(~ignore.ignored(F.col("path"), known))


@query("SELECT DISTINCT 'src/' || p_brand || '.rs' AS path FROM part UNION SELECT 'new/' || p_type FROM part")
def changed_files(spark, sf):
    p = Q._t(spark, sf, "part")
    return repository.changed_files(p.select(F.concat(F.lit("src/"), "p_brand", F.lit(".rs\n")).alias("value")), p.select(F.concat(F.lit("new/"), "p_type").alias("value")))


@query("SELECT 'n' || n_nationkey AS name, 'lib/' || n_nationkey AS path, CASE n_nationkey % 5 WHEN 0 THEN 'uninitialized' WHEN 1 THEN 'bumped' WHEN 2 THEN 'dirty' WHEN 3 THEN 'bumped' ELSE 'clean' END AS state FROM nation")
def submodule_states(spark, sf):
    n = Q._t(spark, sf, "nation")
    key, mark = F.col("n_nationkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("-", "+", " ", "U", " ")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit('path = lost\n[submodule "n'), key, F.lit('"]\n\tpath = lib/'), key, F.lit("\n\turl = ../x=y\n"))
    modules = repository.submodules(n.select(F.concat(key, F.lit("/.gitmodules")).alias("file"), text.alias("text"))).drop("file")
    status = n.select(F.concat(mark, F.lit("0123abcd lib/"), key, F.lit(" (heads/main)")).alias("value"))
    return repository.submodule_states(modules, status, n.filter("n_nationkey % 5 = 2").select(F.concat(F.lit("lib/"), key).alias("path")))


# Extraction: a file of each language for each supplier
_SYMBOLS = "VALUES " + ", ".join(f"('{end}', '{symbol}', '{kind}', {first}, {last})" for end, (_, symbols) in SOURCES.items() for symbol, kind, first, last in symbols)


def _sources(spark, sf):
    key = F.col("s_suppkey").cast("string")
    texts = F.array(*[F.struct(F.concat(F.lit("src/"), key, F.lit(f".{end}")).alias("path"), F.replace(F.lit(text), F.lit("K"), key).alias("text")) for end, (text, _) in SOURCES.items()])
    # few bytes make many files, which are dealt out before they are parsed
    keys = Q._t(spark, sf, "supplier").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return keys.select(F.explode(texts).alias("f")).select("f.*")


@query(f"WITH v(e, s, k, a, b) AS ({_SYMBOLS}) SELECT 'src/' || s_suppkey || '.' || e AS path, replace(s, 'K', s_suppkey::VARCHAR) AS symbol, k AS kind, a::INT AS line_start, b::INT AS line_end FROM supplier, v")
def extract_symbols(spark, sf):
    return files.build(files.extract(_sources(spark, sf))).nodes.select("path", "symbol", "kind", "line_start", "line_end")


@query(f"""WITH v(e, s, k, a, b) AS ({_SYMBOLS}), n AS (SELECT 'src/' || s_suppkey || '.' || e AS path, replace(s, 'K', s_suppkey::VARCHAR) AS symbol FROM supplier, v)
  SELECT x.path, x.symbol AS source, y.symbol AS target, 'CALLS_EXACT' AS kind, 'SAME_FILE_EXACT' AS resolution_kind FROM n x JOIN n y ON x.path = y.path AND lower(string_split(x.symbol, '::')[-1]) LIKE 'open%' AND lower(string_split(y.symbol, '::')[-1]) LIKE 'helper%'""")
def extract_calls(spark, sf):
    g = files.build(files.extract(_sources(spark, sf)))
    name = lambda end, as_: g.nodes.select(F.col("id").alias(end), F.col("path").alias(f"{as_}_path"), F.col("symbol").alias(as_))
    e = g.edges.join(name("src", "source"), "src").join(name("dst", "target"), "dst")
    return e.select(F.col("source_path").alias("path"), "source", "target", "kind", "resolution_kind")


@query("SELECT 'notes/' || s_suppkey || '.md' AS path, 'T' || s_suppkey AS heading, 'Note ' || s_nationkey AS link, 'a.b' || s_suppkey || '()' AS code, 2::BIGINT AS tags FROM supplier")
def markdown_notes(spark, sf):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("---\ntags: [red, blue]\n---\n# T"), key, F.lit("\n\nsee [[Note "), nation, F.lit("]] and `a.b"), key, F.lit("()`\n"))
    f = Q._t(spark, sf, "supplier").select(F.concat(F.lit("notes/"), key, F.lit(".md")).alias("path"), text.alias("text"))
    n = files.notes(f)
    return n.select("path", F.col("headings")[0]["title"].alias("heading"), F.col("links")[0]["target"].alias("link"), F.col("code_refs")[0]["text"].alias("code"), F.size("tags").cast("long").alias("tags"))


@query("SELECT s_suppkey + 0 AS supplier, 'fn f' || s_suppkey || '() {' || chr(10) || '    1' || chr(10) || '}' AS body, '/// says ' || s_name || chr(10) || '// more' AS doc_comment FROM supplier")
def symbol_texts(spark, sf):
    """A symbol's own lines, and the comment right above it."""
    s, key = Q._t(spark, sf, "supplier"), F.col("s_suppkey").cast("string")
    path = F.concat(F.lit("src/"), key, F.lit(".rs"))
    f = s.select(path.alias("path"), F.concat(F.lit("use x;\n\n/// says "), "s_name", F.lit("\n// more\nfn f"), key, F.lit("() {\n    1\n}\n")).alias("text"))
    n = s.select(F.col("s_suppkey").alias("id"), path.alias("path"), F.lit(5).alias("line_start"), F.lit(7).alias("line_end"))
    return files.spans_text(n, f).select(F.col("id").alias("supplier"), "body", "doc_comment")
