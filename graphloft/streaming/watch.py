"""Maintenance from a stream of file events: gated batches and incremental re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.operators.aggregate import bail_out
from graphloft.operators.mutation import merge_identity, purge_file_nodes, purge_outbound
from graphloft.operators.resolve import affected_paths, resolve_refs, unresolved
from graphloft.operators.traverse import radius_gate
from graphloft.schemas import GraphTables
from graphloft.storage import exists, remove

EVENTS = "path string, ts timestamp, text string"


def reindex(g: GraphTables, fresh: GraphTables, changed: DataFrame) -> GraphTables:
    """g with changed files (path) replaced by what `fresh` extracted from them; deleted files have no rows there.

    Ids of symbols that are still there stay. Every file with a reference to an old or new
    short name of a changed file has its outgoing edges derived again, so that the result
    equals a full rebuild.
    """
    if changed.isEmpty():
        return g
    from graphloft.functions.text import short_name

    old = g.nodes.join(changed.select("path"), "path", "left_semi").select(*g.nodes.columns)
    merged = merge_identity(g.nodes, fresh.nodes)
    nodes = purge_file_nodes(g.nodes, changed).unionByName(merged)
    refs = g.raw_refs.join(changed.select("path"), "path", "left_anti").select(*g.raw_refs.columns).unionByName(fresh.raw_refs.select(*g.raw_refs.columns))
    names = fresh.nodes.select(short_name(F.col("symbol")).alias("name"))
    again = affected_paths(g.nodes, g.edges, refs, changed, names)
    kept = purge_outbound(g.nodes, g.edges, again)
    gone = old.select("id").join(merged.select("id"), "id", "left_anti")
    kept = kept.join(gone, kept["dst"] == gone["id"], "left_anti")
    first = nodes.groupBy("repo_id", "path", F.col("symbol").alias("source")).agg(F.min("id").alias("src"))
    part = refs.join(again, "path", "left_semi").join(first, ["repo_id", "path", "source"])
    edges = kept.unionByName(resolve_refs(part, nodes).select(*kept.columns))
    return GraphTables(nodes, edges, {**g.more, "raw_refs": refs, "unresolved_refs": unresolved(refs, nodes)})


class GatedApply:
    """Applies batches of changed files; one that reaches too far waits, and later ones add to it."""

    def __init__(self, spark: SparkSession, folder: str, view: Callable[[], GraphTables], apply: Callable[[DataFrame], None], ceiling: int = 200):
        self.spark, self.pending, self.view, self.apply, self.ceiling = spark, f"{folder.rstrip('/')}/pending", view, apply, ceiling

    def waiting(self) -> DataFrame:
        if exists(self.spark, self.pending):
            return self.spark.read.schema("path string").json(self.pending)
        return self.spark.createDataFrame([], "path string")

    def __call__(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A foreachBatch function over events with a path."""
        if batch.isEmpty():
            return
        changed = batch.select("path").union(self.waiting()).distinct()
        rows = [r["path"] for r in changed.collect()]  # the files of one batch
        changed = self.spark.createDataFrame([(p,) for p in rows], "path string")
        g = self.view()
        _, wait = radius_gate(g.nodes, g.edges, changed, self.ceiling)
        if wait:
            changed.coalesce(1).write.mode("overwrite").json(self.pending)
        else:
            self.apply(changed)  # what waits goes only once it is applied: a batch that fails comes again
            remove(self.spark, self.pending)


def plan_for(changed: int, total: int) -> str:
    """Whether so many changed files call for a full rebuild."""
    return "full" if bail_out(changed, total) else "incremental"


def run(events: DataFrame, apply: GatedApply, checkpoint: str, available_now: bool = False):
    """Starts the stream of events (path, ts) through the gate; the query is returned."""
    w = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")).start()
