"""Traversal: breadth-first search both ways, bounded or not, and what builds on it.

One search serves every operator: it starts from any number of seeds and returns each node
reached once, with its level and the edge that discovered it (the least by source id, then
kind), so that results do not depend on the order of rows. Two executions share these
rules. The distributed one keeps edges sorted by source; a frontier of up to ``SMALL_FRONT``
nodes is looked up by value, which reads the row groups that hold it, and a larger one is
extended by a join and an anti join per level, with levels written to shared storage. Up to ``LOCAL_EDGES`` distinct edges (counted first) the
adjacency fits in the driver, and searching it there takes no jobs per level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.storage import stage

#: Edges up to which a search runs on a collected adjacency.
LOCAL_EDGES = 1_000_000
#: Nodes of a frontier, and nodes found in all, up to which levels are kept in the driver.
SMALL_FRONT, SMALL_REACH = 2_000, 100_000
REACHED = "id long, level int, pred long, edge_kind string, resolution_kind string"


def adjacency(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between known nodes; parallel edges of different kinds are one."""
    e = edges.select("src", "dst")
    if nodes is not None:
        known = nodes.select("id")
        e = e.join(known, e["src"] == known["id"], "left_semi").join(known, e["dst"] == known["id"], "left_semi")
    return e.distinct()


def reverse(edges: DataFrame) -> DataFrame:
    """Edges the other way round."""
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst").select(*edges.columns)


def outbound(edges: DataFrame, node_id: int) -> DataFrame:
    """Direct successors of a node, each once."""
    return edges.filter(F.col("src") == node_id).select(F.col("dst").alias("id")).distinct()


def _typed(edges: DataFrame) -> DataFrame:
    keep = {"kind": F.lit(None).cast("string"), "resolution_kind": F.lit(None).cast("string")}
    return edges.select("src", "dst", *[F.col(k) if k in edges.columns else v.alias(k) for k, v in keep.items()])


def _local(spark: SparkSession, edges: DataFrame, seeds: list[int], hops: int | None) -> DataFrame:
    got = edges.toPandas()
    ids, code = np.unique(np.concatenate([got["src"].to_numpy(np.int64), got["dst"].to_numpy(np.int64), np.array(seeds, np.int64)]), return_inverse=True)
    n = len(got)
    kinds, kind = np.unique(got["kind"].fillna("").to_numpy(str), return_inverse=True) if n else (np.array([""]), np.zeros(0, int))
    hows, rank = np.unique(got["resolution_kind"].fillna("").to_numpy(str), return_inverse=True) if n else (None, np.zeros(0, int))
    order = np.lexsort((rank, kind, code[n : 2 * n], code[:n]))
    src, dst = code[:n][order], code[n : 2 * n][order]
    first = np.searchsorted(src, np.arange(len(ids) + 1))
    level, via = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
    front = np.unique(code[2 * n :])
    level[front], depth = 0, 0
    while len(front) and (hops is None or depth < hops):
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        at = at[level[dst[at]] < 0]
        front, lead = np.unique(dst[at], return_index=True)  # `at` is in (source, kind, resolution) order: the least edge leads
        depth += 1
        level[front], via[front] = depth, at[lead]
    hit = np.flatnonzero(level >= 0)
    edge = via[hit]
    none = edge < 0
    how = got["resolution_kind"].to_numpy(object)[order] if n else np.zeros(0, object)
    rows = [(int(ids[i]), int(level[i]), None if m else int(ids[src[e]]), None if m else (kinds[kind[order[e]]] or None), None if m else how[e]) for i, e, m in zip(hit, edge, none)]
    return spark.createDataFrame([tuple(str(x) if isinstance(x, np.str_) else x for x in r) for r in rows], REACHED)


def search(edges: DataFrame, seeds: DataFrame, hops: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, level, pred, edge_kind, resolution_kind) of all nodes within `hops` of seeds (id), seeds included."""
    spark = edges.sparkSession
    e = _typed(edges).filter("src IS NOT NULL AND dst IS NOT NULL")
    seeds = seeds.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    e = e.repartition("src").groupBy("src", "dst").agg(F.min(F.struct("kind", "resolution_kind")).alias("k")).select("src", "dst", "k.*")
    e = stage(e.sortWithinPartitions("src"), "bfs-edge")  # made once; its count comes from the files' footers
    if e.count() <= local_edges and len(few := seeds.limit(local_edges + 1).collect()) <= local_edges:
        return _local(spark, e, [r["id"] for r in few], hops)
    begin = [r["id"] for r in seeds.limit(SMALL_FRONT + 1).collect()]
    if len(begin) <= SMALL_FRONT:
        rows, front, depth = _small(e, begin, hops)
        if not front:
            return spark.createDataFrame(rows, REACHED)
        known = stage(spark.createDataFrame(rows, REACHED), "bfs-0")
        front, levels = known.filter(F.col("level") == depth), [known]
    else:
        front = stage(seeds.select("id", F.lit(0).alias("level"), F.lit(None).cast("long").alias("pred"), F.lit(None).cast("string").alias("edge_kind"), F.lit(None).cast("string").alias("resolution_kind")), "bfs-0")
        levels, depth = [front], 0
    while hops is None or depth < hops:
        depth += 1
        seen = levels[0].select("id")
        for x in levels[1:]:
            seen = seen.union(x.select("id"))
        step = front.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "kind", "resolution_kind")).alias("m"))
        step = step.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("level"), F.col("m.src").alias("pred"), F.col("m.kind").alias("edge_kind"), F.col("m.resolution_kind"))
        front = stage(step, f"bfs-{depth}")
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _small(e: DataFrame, seeds: list[int], hops: int | None) -> tuple[list[tuple], list[int], int]:
    """(rows found, last level's ids if the search must go on, its depth), level by level while they are few."""
    rows, front, depth = [(i, 0, None, None, None) for i in seeds], seeds, 0
    seen = set(seeds)
    while front and (hops is None or depth < hops):
        if len(front) > SMALL_FRONT or len(rows) > SMALL_REACH:
            return rows, front, depth
        step = e.filter(F.col("src").isin(front)).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "kind", "resolution_kind")).alias("m"))
        got = step.limit(SMALL_REACH + 1).collect()
        if len(got) > SMALL_REACH:
            return rows, front, depth
        depth += 1
        new = [(r["id"], depth, r["m"]["src"], r["m"]["kind"], r["m"]["resolution_kind"]) for r in got if r["id"] not in seen]
        front = [r[0] for r in new]
        seen.update(front)
        rows += new
    return rows, [], depth


def reachable_within(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """Nodes that seeds lead to, seeds included."""
    return search(edges, seeds, hops)


def callers_within(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """Nodes that lead to seeds, seeds included."""
    return search(reverse(_typed(edges)), seeds, hops)


def in_common(*reaches: DataFrame) -> DataFrame:
    """(id) that all of several reach sets (id) hold."""
    out = reaches[0].select("id").distinct()
    for r in reaches[1:]:
        out = out.join(r.select("id"), "id", "left_semi")
    return out


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """(pos, id) along one shortest path, ends included; empty if there is none. Ties go to the least predecessor."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "pos int, id long")
    found = search(edges, spark.createDataFrame([(source,)], "id long"))
    chain, at = [], target
    while at is not None:  # as many steps as the path has edges
        row = found.filter(F.col("id") == at).select("level", "pred").first()
        if row is None:
            return spark.createDataFrame([], "pos int, id long")
        chain.append((row["level"], at))
        at = row["pred"]
    return spark.createDataFrame(chain[::-1], "pos int, id long")


def neighborhood(nodes: DataFrame, edges: DataFrame, root: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth either way of root (root included), and the edges among them."""
    seed = edges.sparkSession.createDataFrame([(root,)], "id long")
    ids = search(edges, seed, depth).select("id").union(callers_within(edges, seed, depth).select("id")).distinct()
    inside = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def call_trace(nodes: DataFrame, edges: DataFrame, root: int, depth: int, precise_only: bool = False) -> DataFrame:
    """(direction, level, id, heuristic) to depth both ways; heuristic hops may be hidden but are still followed."""
    from graphloft.operators.filters import confidence

    seed = edges.sparkSession.createDataFrame([(root,)], "id long")
    weak = confidence(F.col("edge_kind"), F.col("resolution_kind")) == "heuristic"
    out = search(edges, seed, depth).filter(F.col("level") > 0).select(F.lit("outgoing").alias("direction"), "level", "id", F.lit(False).alias("heuristic"))
    back = callers_within(edges, seed, depth).filter(F.col("level") > 0).select(F.lit("incoming").alias("direction"), "level", "id", weak.alias("heuristic"))
    return out.unionByName(back.filter("NOT heuristic") if precise_only else back).join(nodes.select("id", "symbol", "path"), "id")


def blast(nodes: DataFrame, edges: DataFrame, changed: DataFrame, direction: str = "callers", depth: str | int | None = 2) -> DataFrame:
    """(id, level) of what changed files (path) touch, their own symbols included: one search from all seeds."""
    if direction not in ("callers", "callees", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    hops = blast_depth(depth)
    seeds = nodes.join(changed.select("path").distinct(), "path", "left_semi").select("id")
    found = None
    for way, run in (("callers", callers_within), ("callees", reachable_within)):
        if direction in (way, "both"):
            got = run(edges, seeds, hops).select("id", "level")
            found = got if found is None else found.unionByName(got)
    return found.groupBy("id").agg(F.min("level").alias("level")).join(nodes.select("id"), "id", "left_semi")


def blast_depth(depth) -> int | None:
    """A number of hops; 'all' and 'max' mean no bound, what cannot be read means 2."""
    if depth in ("all", "max", None):
        return None
    try:
        return max(0, int(depth))
    except ValueError:
        return 2


def radius_gate(nodes: DataFrame, edges: DataFrame, changed: DataFrame, ceiling: int = 200) -> tuple[int, bool]:
    """(symbols forward of changed files, deferred): a batch at or over the ceiling waits."""
    n = blast(nodes, edges, changed, "callees", None).count()
    return n, n >= ceiling
