"""Registered queries against brute force over whole small tables: nothing of the input may be left out."""

import random

import numpy as np
import pytest

from graphloft.operators import search
from graphloft.plans.registry import QUERIES
from graphloft.sources.projection import OFFSET

ORDERS, PARTS, SUPPLIERS = range(1, 61), range(1, 13), range(1, 10)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A folder of tables, and their line items as (order, line, part, supplier, quantity)."""
    at, rng = str(tmp_path_factory.mktemp("shop")), random.Random(7)
    items = [(o, n + 1, rng.choice(PARTS), rng.choice(SUPPLIERS), float(rng.randint(1, 50))) for o in ORDERS for n in range(rng.randint(1, 4))]
    tables = {
        "region": ([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", n % 2) for n in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(s, f"S{s}", s % 4) for s in SUPPLIERS], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(c, f"C{c}", c % 4) for c in range(1, 8)], "c_custkey long, c_name string, c_nationkey int"),
        "part": ([(p, f"P{p}", f"Brand#{p % 3}", p) for p in PARTS], "p_partkey long, p_name string, p_brand string, p_size int"),
        "orders": ([(o, o % 7 + 1, "O", "1-URGENT") for o in ORDERS], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(*i, "N") for i in items], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at, items


def test_boundary_visibility_keeps_every_order(spark, shop):
    at, items = shop
    got = [tuple(r) for r in QUERIES["boundary_visibility"](spark, at).collect()]
    want = {("part", f"orders::{o}", f"part::{p}") for o, _, p, _, _ in items if p % 2}
    assert len(got) == len(want) and set(got) == want


def ring_edges(items):
    at = {(o, n): s for o, n, _, s, _ in items}
    return {(s, at[o, n + 1]) for (o, n), s in at.items() if (o, n + 1) in at and at[o, n + 1] != s}


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    while True:
        more = {n: r | {b for a, b in edges if a in r} for n, r in out.items()}
        if more == out:
            return out
        out = more


def test_components_and_rings_take_every_line(spark, shop):
    at, items = shop
    edges = ring_edges(items)
    to = reach(edges, SUPPLIERS)
    want = {s: min(x for x in SUPPLIERS if x in to[s] and s in to[x]) for s in SUPPLIERS}
    assert {r["id"]: r["scc"] for r in QUERIES["scc_members"](spark, at).collect()} == want
    inside = {(f"s/{a}", f"s/{b}") for a, b in edges if want[a] == want[b]}
    got = [r["ring"].split(" -> ") for r in QUERIES["file_rings"](spark, at).collect()]
    assert all(r[0] == r[-1] == min(r) and len(set(r)) == len(r) - 1 and set(zip(r, r[1:])) <= inside for r in got)
    # a search closes one ring for each edge that leads back on its path, and what is left has no ring
    back, state = set(), {}

    def visit(a):
        state[a] = 1
        for b in sorted(y for x, y in inside if x == a):
            if state.get(b) == 1:
                back.add((a, b))
            elif b not in state:
                visit(b)
        state[a] = 2

    for a in sorted({x for x, _ in inside}):
        if a not in state:
            visit(a)
    assert len(got) == len({tuple(r) for r in got}) == len(back) > 0
    assert all(len(back & set(zip(r, r[1:]))) == 1 for r in got)


def test_topo_levels_take_every_node_and_edge(spark, shop):
    at, items = shop
    of = OFFSET
    edges = {(of["nation"] + n, of["region"] + n % 2) for n in range(4)} | {(of["supplier"] + s, of["nation"] + s % 4) for s in SUPPLIERS} | {(of["customer"] + c, of["nation"] + c % 4) for c in range(1, 8)}
    edges |= {(of["customer"] + o % 7 + 1, of["orders"] + o) for o in ORDERS} | {(of["orders"] + o, of["part"] + p) for o, _, p, _, _ in items} | {(of["part"] + p, of["supplier"] + s) for _, _, p, s, _ in items}
    nodes = {of[k] + i for k, ids in (("region", range(2)), ("nation", range(4)), ("supplier", SUPPLIERS), ("customer", range(1, 8)), ("part", PARTS), ("orders", ORDERS)) for i in ids}
    level = dict.fromkeys(nodes, 0)
    for _ in range(6):
        for a, b in edges:
            level[b] = max(level[b], level[a] + 1)
    assert {r["id"]: r["level"] for r in QUERIES["topo_levels"](spark, at).collect()} == level


def brute_topk(v, queries, k):
    u = v / np.sqrt((v**2).sum(1, keepdims=True))
    return {q: [int(i) for i in np.lexsort((np.arange(len(v)), -np.round(u[q] @ u.T, 6)))[:k]] for q in queries}


@pytest.mark.parametrize("blocks", [None, 3])
def test_vector_search_recalls_all_of_the_exact_top(spark, tmp_path, blocks):
    v = np.random.default_rng(3).normal(size=(400, 16)).astype(np.float32).astype(np.float64)
    v[150:190] = v[40]  # more ties than k
    spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_topk(v, range(0, 400, 20), 10)
    rows = QUERIES["vector_two_stage"](spark, str(tmp_path)).collect()
    if blocks:
        e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
        rows = search.vector_topk_each(e, e.filter("id % 20 = 0"), 10, blocks).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append(r["id"])
    assert got == want
    one = search.vector_two_stage(spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v"), list(v[0]), 10)
    assert {r["id"] for r in one.collect()} == set(want[0])
