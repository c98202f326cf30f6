"""Several repositories as one graph: composite keys, links across, migration plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloft.functions.text import composite_key, short_name
from graphloft.operators.analytics import strong_components, topological
from graphloft.operators.resolve import cross_repo, links, targets, unknown_at_home


def compose(nodes: DataFrame, edges: DataFrame | None, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with key, edges between keys: LOCAL ones as they are, CROSS_REPO ones from unresolved refs).

    Without edges, LOCAL ones are what refs resolve to. Links to all symbols of a name are reduced to
    different keys on both sides before they are paired, as many symbols can have one key.
    """
    keyed = nodes.withColumn("key", composite_key(F.col("repo_id"), F.col("path"), F.col("symbol")))
    k = keyed.select("id", "key", "repo_id")
    source = k.select(F.col("id").alias("src"), F.col("key").alias("source"), F.col("repo_id").alias("source_repo"))
    target = k.select(F.col("id").alias("dst"), F.col("key").alias("target"), F.col("repo_id").alias("target_repo"))
    # names with a symbol of their own repository are no refs across, so those left are linked to all that have a repository
    across = unknown_at_home(refs, nodes).filter("repo_id IS NOT NULL").select("src", "name", F.lit("CROSS_REPO").alias("kind"))
    if edges is None:
        found = links(refs, nodes)
        edges = found.filter("NOT many")
        across = across.unionByName(found.filter("many").select("src", "name", F.lit("LOCAL").alias("kind")))
    columns = ("source", "target", "kind", "source_repo", "target_repo")
    e = edges.select("src", "dst", F.lit("LOCAL").alias("kind")).distinct().join(source, "src").join(target, "dst").select(*columns)
    ends = targets(nodes).select("name", "dst", F.col("dst_repo").isNotNull().alias("placed")).join(target, "dst")
    ends = ends.groupBy("name", "target", "target_repo").agg(F.max("placed").alias("placed"))
    starts = across.join(source, "src").select("source", "source_repo", "name", "kind").distinct()
    paired = starts.join(ends, "name").filter("kind = 'LOCAL' OR placed").select(*columns)
    return keyed, e.unionByName(paired).distinct()


def repo_cycles(links: DataFrame) -> DataFrame:
    """(repo, scc): repositories that depend on each other in a circle."""
    repos = links.select(F.col("source_repo").alias("r")).union(links.select("target_repo")).distinct().withColumn("id", F.xxhash64("r"))
    e = links.filter("source_repo <> target_repo").select(F.xxhash64("source_repo").alias("src"), F.xxhash64("target_repo").alias("dst"))
    c = repos.join(strong_components(repos, e), "id")
    many = c.groupBy("scc").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("name")).filter("n > 1")
    return c.join(many, "scc").select(F.col("r").alias("repo"), F.col("name").alias("scc"))


def survey(nodes: DataFrame, refs: DataFrame, symbol: str) -> dict:
    """Plan for changing a symbol: its repository, repositories that use it from outside, an order, or the refusal."""
    name = symbol.rsplit("::", 1)[-1]
    own = [r["repo_id"] for r in nodes.filter((F.col("symbol") == symbol) | (short_name(F.col("symbol")) == name)).select("repo_id").distinct().collect()]
    if len(own) != 1:
        return {"provider": None, "affected": [], "order": None, "why": "no provider" if not own else "several providers"}
    users = refs.filter((F.col("name") == name) & (F.col("repo_id") != own[0])).select("repo_id").distinct()
    affected = sorted(r["repo_id"] for r in users.collect())
    links = cross_repo(refs, nodes).join(nodes.select(F.col("id").alias("src"), F.col("repo_id").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("repo_id").alias("b")), "dst").select("a", "b").distinct().collect()  # pairs of repositories
    names = sorted({own[0], *affected})
    order = topological(names, [(r["b"], r["a"]) for r in links if r["a"] in names and r["b"] in names])
    return {"provider": own[0], "affected": affected, "order": order, "why": None if order else "repositories depend on each other in a circle"}


def dedupe_violations(violations: DataFrame) -> DataFrame:
    """Violations of several peers, each once."""
    return violations.groupBy("kind", "from", "to").agg(F.max("n").alias("n"))
