"""Writes as DataFrame algebra: upserts by natural key, identity-preserving merges, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_KEY = ("repo_id", "path", "symbol", "line_start")
EDGE_KEY = ("src", "dst", "kind")


def last_wins(rows: DataFrame, key, seq: str) -> DataFrame:
    """Of rows with one key, that with the largest `seq`."""
    rest = [c for c in rows.columns if c not in key]
    order = [seq, *[c for c in rest if c != seq]]
    return rows.groupBy(*key).agg(F.max(F.struct(*order)).alias("_m")).select(*[c if c in key else F.col(f"_m.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """old with new's rows in place of those with their keys."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def upsert_edges(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    return upsert(old, last_wins(new, EDGE_KEY, seq).drop(seq), EDGE_KEY)


def merge_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """new's nodes with the ids they had: same place and kind, then equal signature, else equal first line.

    Each old id is given once. Rows without a partner get ids above all others, in order of
    place, so that a rerun gives the same ids.
    """
    place = ["repo_id", "path", "symbol", "kind"]
    n = new.drop("id").withColumn("_row", F.struct(*place, "line_start", "line_end", "signature"))
    o = old.select(*place, F.col("id").alias("_id"), F.col("signature").alias("_sig"), F.col("line_start").alias("_line"))
    rank = F.when(F.col("signature") == F.col("_sig"), 0).when(F.col("line_start") == F.col("_line"), 1)
    c = n.join(o, place).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    # Mutual best candidates by (rank, distance in lines, id): signature matches first, lines for what is left.
    pairs = None
    for r in (0, 1):
        x = c.filter(F.col("_rank") == r)
        if pairs is not None:
            x = x.join(pairs.select("_row"), "_row", "left_anti").join(pairs.select("_id"), "_id", "left_anti")
        near = F.abs(F.col("line_start") - F.col("_line"))
        x = x.withColumn("_a", F.row_number().over(Window.partitionBy("_row").orderBy(near, "_id"))).filter("_a = 1")
        x = x.withColumn("_b", F.row_number().over(Window.partitionBy("_id").orderBy(near, "_row"))).filter("_b = 1").select("_row", "_id")
        pairs = x if pairs is None else pairs.unionByName(x)
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    merged = n.join(pairs, "_row", "left").join(top)
    fresh = F.row_number().over(Window.partitionBy(F.col("_id").isNull()).orderBy("_row"))
    return merged.withColumn("id", F.coalesce("_id", F.col("_top") + fresh)).select(*old.columns)


def purge_file_edges(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """edges without those that start or end in the files (path)."""
    ids = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_anti").join(ids, edges["dst"] == ids["id"], "left_anti")


def purge_outbound(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """edges without those that start in the files."""
    ids = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_anti")


def purge_file_nodes(nodes: DataFrame, paths: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """nodes without those of the files, but for retained ids."""
    gone = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    if retained is not None:
        gone = gone.join(retained.select("id"), "id", "left_anti")
    return nodes.join(gone, "id", "left_anti")


def purge_orphans(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """nodes without those of a kind that no edge leads to."""
    gone = nodes.filter(F.col("kind") == kind).select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    return nodes.join(gone, "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with an end that is no node; empty in a sound store."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_anti").unionByName(edges.join(ids, edges["dst"] == ids["id"], "left_anti")).distinct()


def source_paths_for_targets(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose symbols have edges into the given files."""
    into = nodes.join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("dst"))
    return edges.join(into, "dst", "left_semi").select(F.col("src").alias("id")).join(nodes.select("id", "path"), "id").select("path").distinct()
