"""Aggregations, top-k and budgets over graphs and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloft.functions.text import token_count


def _paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the paths of both ends (a: source, b: target)."""
    a = nodes.select(F.col("id").alias("src"), F.col("path").alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("path").alias("b"))
    return edges.join(a, "src").join(b, "dst")


def file_pair_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight): how many edges join two files, in either direction; an edge's own weight is not used."""
    e = _paths(nodes, edges).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): weights summed over unordered pairs, without loops and weights that are not positive."""
    return edges.filter("src <> dst AND weight > 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def weighted_degree(pairs: DataFrame) -> DataFrame:
    """(node, degree) from (a, b, weight)."""
    return pairs.select(F.col("a").alias("node"), "weight").unionByName(pairs.select(F.col("b").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("degree"))


def hub_files(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(path, degree, symbols): files by distinct outgoing edges of their symbols, then name."""
    out = edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("src"), "path"), "src").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("degree"))
    held = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"))
    return held.join(out, "path", "left").select("path", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "symbols").orderBy(F.desc("degree"), "path").limit(limit)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def inter_module_weights(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, weight) between modules, from file pairs and (path, module)."""
    a = members.select(F.col("path").alias("a"), F.col("module").alias("ma"))
    b = members.select(F.col("path").alias("b"), F.col("module").alias("mb"))
    m = pairs.join(a, "a").join(b, "b").filter("ma <> mb")
    return m.groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.sum("weight").alias("weight"))


def orphan_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no other file's edge leads to."""
    used = _paths(nodes, edges).filter("a <> b").select(F.col("b").alias("path")).distinct()
    return nodes.select("path").distinct().join(used, "path", "left_anti")


def span_stats(spans: DataFrame, *keys: str) -> DataFrame:
    """Count, errors, sum, least, most and nearest-rank percentiles of durations; zeros over no spans."""
    d, none = F.col("duration_us"), lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY duration_us)")
    return spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lower("status") == "error").alias("errors"), none(F.sum(d)).alias("total_us"), none(F.min(d)).alias("min_us"), none(F.max(d)).alias("max_us"),
        none(rank(0.5)).alias("p50_us"), none(rank(0.95)).alias("p95_us"), none(rank(0.99)).alias("p99_us"),
    )


def label_mode(members: DataFrame) -> DataFrame:
    """(module, label): the folder that most of a module's files are in; ties by name."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    n = members.select("module", folder.alias("label")).groupBy("module", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("module").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


def contract_hash(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, hash): SHA-256 over sorted lines, each ended by a line break; of nothing for no lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.concat(x, F.lit("\n"))), "")
    return lines.groupBy(*keys).agg(F.sha2(text, 256).alias("hash"))


def first_per_group(df: DataFrame, group: str, limit: int, *order) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")


def budget_prefix(df: DataFrame, text: Column, budget: int, *order, group: str | None = None) -> DataFrame:
    """The longest prefix (in the given order) whose word counts sum to at most the budget."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(token_count(text)).over(w)).filter(F.col("used") <= budget)


def capped(df: DataFrame, limit: int, *order) -> DataFrame:
    """Rows up to a limit, with the rest as one overflow count (`over`)."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(*order)))
    rest = r.agg(F.count_if(F.col("_r") > limit).alias("over"))
    return r.filter(F.col("_r") <= limit).drop("_r").join(rest)


def round_rank(values: list[float], p: float) -> float:
    """The router report's percentile: the value at round(p * (n - 1)); 0 for none."""
    v = sorted(values)
    return v[int(p * (len(v) - 1) + 0.5)] if v else 0.0


def bail_out(changed: int, total: int, floor: int = 100, share: float = 0.10) -> bool:
    """Whether so many files changed that a full rebuild is cheaper."""
    return changed > max(floor, int(total * share))
