import itertools

import pytest
from pyspark.sql import functions as F

from graphloft.operators import aggregate, analytics, filters, gates, mutation, traverse
from graphloft.plans import query


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


CHAIN = ([1, 2, 3, 4, 9], [(1, 2), (2, 3), (3, 4)])


def test_chain(spark, graph):
    g = graph(*CHAIN)
    seed = spark.createDataFrame([(2,)], "id long")
    assert ids(traverse.reachable_within(g.edges, seed)) == [2, 3, 4]
    assert ids(traverse.callers_within(g.edges, seed)) == [1, 2]
    assert ids(query.run(g, "callers(m::s3)")) == [1, 2]
    assert ids(query.run(g, "callees(m::s2)")) == [3]
    assert ids(query.run(g, "impact(m::s1)")) == [2, 3, 4]
    path = lambda a, b: [r["id"] for r in traverse.shortest_path(g.edges, a, b).orderBy("pos").collect()]
    assert path(1, 4) == [1, 2, 3, 4] and path(2, 2) == [2] and path(4, 1) == [] and path(1, 9) == []


@pytest.mark.parametrize("hops", [0, 1, 2, None])
def test_local_and_distributed_search_agree(spark, graph, hops):
    edges = [(a, b, k) for a, b in itertools.product(range(1, 8), repeat=2) if (a * 5 + b * 3) % 7 in (1, 2) for k in ("X", "Y")]
    g = graph(list(range(1, 8)), edges)
    seeds = spark.createDataFrame([(1,), (4,)], "id long")
    a, b = (sorted(map(tuple, traverse.search(g.edges, seeds, hops, limit).collect()), key=str) for limit in (10**6, 0))
    assert a == b


def test_precise_and_first_edge(spark, graph):
    g = graph([1, 2, 3], [(1, 3, "CALLS_EXACT", "UNIQUE_GLOBAL_EXACT"), (2, 3, "CALLS_DYNAMIC", "AMBIGUOUS_HEURISTIC")])
    assert ids(query.run(g, "callers(m::s3) precise:true")) == [1]
    assert ids(query.run(g, "callers(m::s3) precise:false")) == [1, 2]
    assert ids(query.run(g, "callers(m::s3) edge:CALLS_DYNAMIC")) == [2]


@pytest.mark.parametrize("text", ["callers", "callers()", "path(a)", "jump(a)", "callees(a) edge:X", "path(a,b) kind:x", "callers(a) precise:maybe", "callers(a) size:3", "impact(a) visibility:some"])
def test_query_errors(text):
    with pytest.raises(query.QueryError):
        query.parse(text)


def test_resolution_of_symbols(spark, graph):
    g = graph([1, 2], [])
    assert query.resolve_symbol(g.nodes, "m::s1") == query.resolve_symbol(g.nodes, "M::S1") == query.resolve_symbol(g.nodes, "s1") == 1
    with pytest.raises(query.QueryError) as e:
        query.resolve_symbol(g.nodes, "m::s9")
    assert e.value.suggestions[:2] == ["m::s1", "m::s2"]


def test_blast_keeps_seeds_and_reads_depths(spark, graph):
    g = graph(*CHAIN)
    hit = traverse.blast(g.nodes, g.edges, spark.createDataFrame([("src/f2.rs",)], "path string"), "both", "all")
    assert ids(hit) == [1, 2, 3, 4]
    assert traverse.blast_depth("x") == 2 and traverse.blast_depth("max") is None
    with pytest.raises(ValueError):
        traverse.blast(g.nodes, g.edges, spark.createDataFrame([("p",)], "path string"), "sideways")


def test_communities():
    c = analytics.communities
    two = c([1, 2, 3, 4, 5, 6], [(a, b, 5.0) for a, b in ((1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6))] + [(3, 4, 1.0)])
    assert two[1] == two[2] == two[3] != two[4] == two[5] == two[6]
    assert len(set(c([1, 2, 3, 4], [(a, b, 1.0) for a, b in itertools.combinations([1, 2, 3, 4], 2)]).values())) == 1
    assert len(set(c([1, 2], [(1, 1, 3.0), (1, 2, 0.0), (1, 2, -1.0)]).values())) == 2
    pairs = [(1, 2, 3.0), (2, 3, 0.1)]
    assert analytics.modularity(pairs, c([1, 2, 3], pairs)) >= analytics.modularity(pairs, {1: 1, 2: 2, 3: 3})


def test_rings_and_order(spark, graph):
    assert analytics.rings([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("a", "a")]) == [("a", "b", "c", "a")]
    assert analytics.rings([("a", "c"), ("c", "b"), ("b", "c")]) == [("b", "c", "b")]
    assert analytics.topological([1, 2, 3], [(3, 1), (1, 2), (3, 1)]) == [3, 1, 2]
    assert analytics.topological([1, 2], [(1, 2), (2, 1)]) is None
    g = graph([1, 2, 3, 4, 5], [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)])
    scc = {r["id"]: r["scc"] for r in analytics.strong_components(g.nodes, g.edges).collect()}
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert analytics.topological_levels(g.nodes, g.edges) is None
    h = graph([(1, "b.rs"), (2, "c.rs"), (3, "b.rs"), (4, "a.rs")], [(1, 2), (2, 3), (4, 2)])
    assert [r["ring"] for r in analytics.file_rings(h.nodes, h.edges).collect()] == ["b.rs -> c.rs -> b.rs"]


def test_orphans_and_pairs(graph):
    g = graph([(1, "a"), (2, "b"), (3, "b"), (4, "c")], [(1, 2), (2, 3)])
    assert sorted(r["path"] for r in aggregate.orphan_files(g.nodes, g.edges).collect()) == ["a", "c"]
    assert [tuple(r) for r in aggregate.file_pair_weights(g.nodes, g.edges).collect()] == [("a", "b", 1)]


@pytest.mark.parametrize("changed,total,out", [(99, 1000, False), (101, 1000, True), (50, 10, False), (101, 10, True)])
def test_bail_out(changed, total, out):
    assert aggregate.bail_out(changed, total) is out


def test_purges_leave_nothing_dangling(spark, graph):
    g = graph([(1, "a.rs"), (2, "b.rs"), (3, "c.rs")], [(1, 2), (2, 1), (3, 2)])
    paths = spark.createDataFrame([("a.rs",)], "path string")
    e = mutation.purge_file_edges(g.nodes, g.edges, paths)
    assert [(r["src"], r["dst"]) for r in e.collect()] == [(3, 2)]
    assert mutation.dangling(mutation.purge_file_nodes(g.nodes, paths), e).isEmpty()


def test_identity_merge(spark, graph):
    old = graph([1, 2, 3], []).nodes
    moved = old.withColumn("line_start", F.when(F.col("id") == 1, 50).otherwise(F.col("line_start")).cast("int")).withColumn("signature", F.when(F.col("id") == 2, "pub fn other()").otherwise(F.col("signature")))
    new = moved.filter("id < 3").unionByName(moved.filter("id = 3").withColumn("symbol", F.lit("m::fresh")))
    got = {r["symbol"]: r["id"] for r in mutation.merge_identity(old, new).collect()}
    assert got == {"m::s1": 1, "m::s2": 2, "m::fresh": 4}


def test_masking(spark, graph):
    g = graph([(1, "a.py"), (2, "b/_x.md"), (3, "z.unknown")], [(1, 2), (1, 3)])
    out = filters.Identity()
    shown = {r["id"]: r["symbol"] for r in filters.mask(g.nodes, out.visible()).collect()}
    assert shown == {1: "m::s1", 2: filters.HIDDEN, 3: filters.HIDDEN}
    inside = filters.Identity(("internal",), ("b",))
    assert ids(g.nodes.filter(inside.visible())) == [1, 2]
    assert filters.drop_hidden(g.nodes, g.edges, inside.visible())[1].count() == 1
    assert filters.hidden_counts(g.nodes, g.edges, out.visible()).first() == (2, 2)


def test_gates(spark, graph):
    g = graph([(1, "ui/a.rs"), (2, "db/b.rs"), (3, "uix/c.rs")], [(1, 2), (3, 2)])
    rules = [gates.Rule.load({"disallow": {"from": "ui", "to": "db"}}), gates.Rule.load({"require": {"from": "db", "to": "ui"}}), gates.Rule.load({"disallow": {"from": "uix", "to": "db"}, "allowed_roles": ["ops"]})]
    got = {(r["kind"], r["from"]): (r["n"], r["samples"]) for r in gates.lint(g.nodes, g.edges, rules, ("ops",)).collect()}
    assert got == {("disallow", "ui"): (1, ["m::s1 -> m::s2"]), ("require", "db"): (0, [])}
    with pytest.raises(ValueError):
        gates.Rule.load({"disallow": {"from": "a", "to": "b"}, "require": {"from": "a", "to": "b"}})
    assert (gates.verdict(0, 0), gates.verdict(0, 1), gates.verdict(2, 1)) == ("pass", "incomplete", "fail")
    none = spark.createDataFrame([], "path string, short_name string")
    r = gates.review(g.nodes, g.edges, none, spark.createDataFrame([("db/b.rs",)], "path string"), rules, filters.Identity(("ops", "allow-drift")), ["policy:disallow:ui->db"], "known")
    assert (r.risk, r.waived, r.failed) == ("Medium", ["policy:disallow:ui->db"], True)
    with pytest.raises(ValueError):
        gates.waive(filters.Identity(("allow-drift",)), " ")


def test_empty_tables(spark, graph):
    g = graph([], [])
    seed = spark.createDataFrame([], "id long")
    assert traverse.search(g.edges, seed).isEmpty()
    for df in (aggregate.file_pair_weights(g.nodes, g.edges), aggregate.orphan_files(g.nodes, g.edges), aggregate.hub_files(g.nodes, g.edges), analytics.strong_components(g.nodes, g.edges)):
        assert df.isEmpty()


def test_results_do_not_depend_on_row_order(spark, graph):
    g = graph(list(range(1, 30)), [(a, (a * 7) % 29 + 1) for a in range(1, 30)])
    seed = spark.createDataFrame([(5,)], "id long")
    one = sorted(traverse.search(g.edges, seed).collect())
    two = sorted(traverse.search(g.edges.repartition(3).orderBy(F.desc("dst")), seed).collect())
    assert one == two
