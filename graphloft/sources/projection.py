"""The graph that relational tables hold: rows are symbols, keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.schemas import GraphTables

#: Node ids: a table's number times STEP, plus its key.
STEP = 10**12
ORDER = ("region", "nation", "supplier", "customer", "part", "orders")
OFFSET = {name: (i + 1) * STEP for i, name in enumerate(ORDER)}


def _nodes(df: DataFrame, kind: str, key: str, path, signature) -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(
        (k + F.lit(OFFSET[kind])).alias("id"), F.lit("shop").alias("repo_id"), F.concat(F.lit(f"{kind}/"), path).alias("path"), F.concat(F.lit(f"{kind}::"), k.cast("string")).alias("symbol"), F.lit(kind).alias("kind"),
        (k % 1000 + 1).cast("int").alias("line_start"), (k % 1000 + 6).cast("int").alias("line_end"), signature.alias("signature"),
    )


def graph(spark: SparkSession, sf_dir: str) -> GraphTables:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c, s = F.col, lambda name: F.col(name).cast("string")
    nodes = (
        _nodes(t("region"), "region", "r_regionkey", F.lit("all"), c("r_name"))
        .unionByName(_nodes(t("nation"), "nation", "n_nationkey", s("n_regionkey"), c("n_name")))
        .unionByName(_nodes(t("supplier"), "supplier", "s_suppkey", s("s_nationkey"), c("s_name")))
        .unionByName(_nodes(t("customer"), "customer", "c_custkey", s("c_nationkey"), c("c_name")))
        .unionByName(_nodes(t("part"), "part", "p_partkey", c("p_brand"), F.when(c("p_size") % 2 == 0, F.concat(F.lit("pub fn "), c("p_name"))).otherwise(F.concat(F.lit("fn "), c("p_name")))))
        .unionByName(_nodes(t("orders"), "orders", "o_orderkey", c("o_orderpriority"), c("o_orderstatus")))
    )
    at = lambda name, key: c(key).cast("long") + F.lit(OFFSET[name])
    none = F.lit(None).cast("string")

    def edge(df, src, dst, kind, weight=None, how=None):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight") if weight is None else weight.alias("weight"), F.lit("keys").alias("extractor"), (none if how is None else how).alias("resolution_kind"))

    how = F.when(c("flag") == "R", "AMBIGUOUS_HEURISTIC").when(c("flag") == "A", "UNIQUE_GLOBAL_EXACT").otherwise("SAME_FILE_EXACT")
    item = t("lineitem")
    # One edge per natural key: the line with the largest number is the last write.
    last = item.groupBy("l_orderkey", "l_partkey").agg(F.max(F.struct("l_linenumber", c("l_quantity").alias("qty"), c("l_returnflag").alias("flag"), "l_suppkey")).alias("m")).select("l_orderkey", "l_partkey", "m.*")
    supplied = item.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    edges = (
        edge(t("nation"), at("nation", "n_nationkey"), at("region", "n_regionkey"), "PART_OF")
        .unionByName(edge(t("supplier"), at("supplier", "s_suppkey"), at("nation", "s_nationkey"), "LOCATED_IN"))
        .unionByName(edge(t("customer"), at("customer", "c_custkey"), at("nation", "c_nationkey"), "LOCATED_IN"))
        .unionByName(edge(t("orders"), at("customer", "o_custkey"), at("orders", "o_orderkey"), "PLACED"))
        .unionByName(edge(last, at("orders", "l_orderkey"), at("part", "l_partkey"), "CONTAINS", c("qty"), how))
        .unionByName(edge(supplied, at("part", "l_partkey"), at("supplier", "l_suppkey"), "SUPPLIED_BY", c("n")))
    )
    return GraphTables(nodes, edges)


#: The same projection for DuckDB, as leading common table expressions.
SQL = f"""
nodes AS (
  SELECT {OFFSET['region']} + r_regionkey AS id, 'shop' AS repo_id, 'region/all' AS path, 'region::' || r_regionkey AS symbol, 'region' AS kind, CAST(r_regionkey % 1000 + 1 AS INT) AS line_start, CAST(r_regionkey % 1000 + 6 AS INT) AS line_end, r_name AS signature FROM region
  UNION ALL SELECT {OFFSET['nation']} + n_nationkey, 'shop', 'nation/' || n_regionkey, 'nation::' || n_nationkey, 'nation', CAST(n_nationkey % 1000 + 1 AS INT), CAST(n_nationkey % 1000 + 6 AS INT), n_name FROM nation
  UNION ALL SELECT {OFFSET['supplier']} + s_suppkey, 'shop', 'supplier/' || s_nationkey, 'supplier::' || s_suppkey, 'supplier', CAST(s_suppkey % 1000 + 1 AS INT), CAST(s_suppkey % 1000 + 6 AS INT), s_name FROM supplier
  UNION ALL SELECT {OFFSET['customer']} + c_custkey, 'shop', 'customer/' || c_nationkey, 'customer::' || c_custkey, 'customer', CAST(c_custkey % 1000 + 1 AS INT), CAST(c_custkey % 1000 + 6 AS INT), c_name FROM customer
  UNION ALL SELECT {OFFSET['part']} + p_partkey, 'shop', 'part/' || p_brand, 'part::' || p_partkey, 'part', CAST(p_partkey % 1000 + 1 AS INT), CAST(p_partkey % 1000 + 6 AS INT), CASE WHEN p_size % 2 = 0 THEN 'pub fn ' ELSE 'fn ' END || p_name FROM part
  UNION ALL SELECT {OFFSET['orders']} + o_orderkey, 'shop', 'orders/' || o_orderpriority, 'orders::' || o_orderkey, 'orders', CAST(o_orderkey % 1000 + 1 AS INT), CAST(o_orderkey % 1000 + 6 AS INT), o_orderstatus FROM orders),
last_line AS (
  SELECT l_orderkey, l_partkey, arg_max(l_quantity, (l_linenumber, l_quantity, l_returnflag, l_suppkey)) AS qty, arg_max(l_returnflag, (l_linenumber, l_quantity, l_returnflag, l_suppkey)) AS flag FROM lineitem GROUP BY ALL),
edges AS (
  SELECT {OFFSET['nation']} + n_nationkey AS src, {OFFSET['region']} + n_regionkey AS dst, 'PART_OF' AS kind, 1.0::DOUBLE AS weight, NULL::VARCHAR AS resolution_kind FROM nation
  UNION ALL SELECT {OFFSET['supplier']} + s_suppkey, {OFFSET['nation']} + s_nationkey, 'LOCATED_IN', 1.0, NULL FROM supplier
  UNION ALL SELECT {OFFSET['customer']} + c_custkey, {OFFSET['nation']} + c_nationkey, 'LOCATED_IN', 1.0, NULL FROM customer
  UNION ALL SELECT {OFFSET['customer']} + o_custkey, {OFFSET['orders']} + o_orderkey, 'PLACED', 1.0, NULL FROM orders
  UNION ALL SELECT {OFFSET['orders']} + l_orderkey, {OFFSET['part']} + l_partkey, 'CONTAINS', qty, CASE flag WHEN 'R' THEN 'AMBIGUOUS_HEURISTIC' WHEN 'A' THEN 'UNIQUE_GLOBAL_EXACT' ELSE 'SAME_FILE_EXACT' END FROM last_line
  UNION ALL SELECT {OFFSET['part']} + l_partkey, {OFFSET['supplier']} + l_suppkey, 'SUPPLIED_BY', count(*)::DOUBLE, NULL FROM lineitem GROUP BY l_partkey, l_suppkey)
"""
