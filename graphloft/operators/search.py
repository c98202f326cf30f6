"""Lexical, literal and vector search, rank fusion, similar pairs and coupling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloft.functions.porter import stem_column
from graphloft.functions.text import cosine, expand_query, split_identifier
from graphloft.operators.filters import any_glob, in_module

#: Weights of a lexical row's columns, and Okapi constants.
WEIGHTS = {"symbol_name": 10.0, "signature": 5.0, "body": 1.0, "doc_comment": 2.0}
K1, B = 1.2, 0.75
MOST, RRF_K = 100, 60


def lexical_rows(nodes: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(id, symbol_name, signature, body, doc_comment): the text columns of nodes."""
    a = nodes.select("id", split_identifier(F.col("symbol")).alias("symbol_name"), "signature")
    if bodies is None:
        return a.withColumns({"body": F.lit(""), "doc_comment": F.lit("")})
    return a.join(bodies.select("id", "body", "doc_comment"), "id", "left").fillna("", ["body", "doc_comment"])


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, columns=tuple(WEIGHTS), stemmed: bool = True) -> DataFrame:
    """(term, id, col, tf) of text rows; stemming is by batches, on distinct terms only."""
    each = None
    for c in columns:
        p = rows.select("id", F.lit(c).alias("col"), F.explode(terms(F.col(c))).alias("term"))
        each = p if each is None else each.unionByName(p)
    n = each.groupBy("term", "id", "col").agg(F.count(F.lit(1)).alias("tf"))
    if not stemmed:
        return n
    stems = n.select("term").distinct().withColumn("stem", stem_column(F.col("term")))
    return n.join(stems, "term").groupBy(F.col("stem").alias("term"), "id", "col").agg(F.sum("tf").alias("tf"))


def bm25(posts: DataFrame, rows: DataFrame, query: str, limit: int | None = None, weights=None, stemmed: bool = True) -> DataFrame:
    """(id, score, rank) of rows that match every term group of the query, best first."""
    from graphloft.functions.porter import stem

    weights = weights or WEIGHTS
    norm = stem if stemmed else (lambda x: x)
    groups = [sorted({norm(w) for w in g}) for g in expand_query(query)]
    size = posts.groupBy("id").agg(F.sum("tf").alias("len"))
    n, mean = rows.count(), size.agg(F.avg("len")).first()[0] or 1.0
    wanted = posts.filter(F.col("term").isin(sorted({w for g in groups for w in g})))
    weight = F.coalesce(*[F.when(F.col("col") == c, w) for c, w in weights.items()], F.lit(1.0))
    tf = wanted.groupBy("term", "id").agg(F.sum(F.col("tf") * weight).alias("tf"))
    df = wanted.groupBy("term").agg(F.countDistinct("id").alias("df"))
    hit = tf.join(F.broadcast(df), "term").join(size, "id")  # df: a row for each query term
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    every = [F.max(F.col("term").isin(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    out = hit.groupBy("id").agg(F.sum(part).alias("score"), *every)
    for i in range(len(groups)):
        out = out.filter(f"g{i}")
    top = out.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(min(limit or MOST, MOST))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "id")))


def find_all(posts: DataFrame, nodes: DataFrame, query: str, stemmed: bool = True) -> DataFrame:
    """Every node that matches, unranked and without a limit."""
    from graphloft.functions.porter import stem

    out = nodes
    for g in expand_query(query):
        ids = posts.filter(F.col("term").isin(sorted({stem(w) if stemmed else w for w in g}))).select("id").distinct()
        out = out.join(ids, "id", "left_semi")
    return out


def vector_topk(vectors: DataFrame, query: list[float], k: int, visible: Column | None = None) -> DataFrame:
    """(id, score, rank): exact cosine top k of (id, v); hidden rows are out before the limit."""
    v = vectors if visible is None else vectors.filter(visible)
    q = F.array(*[F.lit(float(x)) for x in query])
    top = v.select("id", F.round(cosine(F.col("v"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "id")))


def vector_two_stage(vectors: DataFrame, query: list[float], k: int, visible: Column | None = None) -> DataFrame:
    """(id, score): exact cosine top k, by block and then over blocks."""
    check_dims(vectors, len(query))
    one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "id long, v array<double>")
    return vector_topk_each(vectors if visible is None else vectors.filter(visible), one, k).select("id", "score")


def check_dims(vectors: DataFrame, n: int) -> None:
    """Vectors of another length than the query's are an error; no vectors are not."""
    bad = vectors.filter(F.size("v") != n).limit(1).collect()
    if bad:
        raise ValueError(f"query has {n} dimensions, vector {bad[0]['id']} has {len(bad[0]['v'])}")


def rrf(lists: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """(id, score, rank) from (list, rank0, id): reciprocal ranks summed; an id counts once in a list."""
    once = lists.groupBy("list", "id").agg(F.min("rank0").alias("rank0"))
    top = once.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank0") + 1)), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "id")))


#: Vectors of one block: what a task holds of either side.
BLOCK = 2048


def vector_topk_each(vectors: DataFrame, queries: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(query, id, score, rank): of each query (id, v) the k vectors of largest cosine; ties go to the least id.

    Exact, in blocks: queries and vectors are dealt into blocks, a pair of blocks is one
    group and one matrix product, of which each query's best k leave. No vector is left
    out before it is scored.
    """
    across = lambda df: blocks or max(1, -(-df.count() // BLOCK))
    nq, nv = across(queries), across(vectors)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = F.col("v").cast("array<double>").alias("v")
    both = queries.select(F.lit(True).alias("asks"), "id", v, dealt(nq).alias("x"), every(nv).alias("y")).unionByName(vectors.select(F.lit(False).alias("asks"), "id", v, every(nq).alias("x"), dealt(nv).alias("y")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if asks.all() or not asks.any():
            return none
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        length = np.sqrt((m**2).sum(1, keepdims=True))
        m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        ids = pdf["id"].to_numpy()
        mine = ids[~asks]
        sim = np.round(m[asks] @ m[~asks].T, 6)
        most = min(k, len(mine))
        least = np.partition(sim, len(mine) - most, 1)[:, len(mine) - most]
        out = [none]
        for q, row, low in zip(ids[asks], sim, least):
            at = np.flatnonzero(row >= low)
            at = at[np.lexsort((mine[at], -row[at]))[:most]]
            out.append(pd.DataFrame({"query": q, "id": mine[at], "score": row[at]}))
        return pd.concat(out)

    best = both.groupBy("x", "y").applyInPandas(work, "query long, id long, score double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """(a, b, sim), a < b: pairs of vectors with cosine similarity of at least `threshold`.

    Exact, in blocks: ids are dealt into blocks, each pair of blocks is one group, and a
    group's products are one matrix product. A vector is sent once to each block.
    """
    n = vectors.count()
    k = blocks or max(1, -(-n // BLOCK))
    v = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("blk"))
    pair = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    both = v.select("id", "v", "blk", pair.alias("o")).select("id", "v", "blk", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        length = np.sqrt((m**2).sum(1, keepdims=True))
        m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        ids, blk = pdf["id"].to_numpy(), pdf["blk"].to_numpy()
        a, b = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        sim = np.round(m[a] @ m[b].T, 6)
        i, j = np.nonzero(sim >= threshold)
        p, q = ids[a[i]], ids[b[j]]
        s = sim[i, j]
        keep = p < q if x == y else p != q
        return pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "sim": s[keep]})

    return both.groupBy("x", "y").applyInPandas(work, "a long, b long, sim double")


def coupling(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, within: str, threshold: float, exempt=()) -> DataFrame:
    """(a, b, sim): files that are alike but declare no edge; pairs are (a, b, sim) of node ids."""
    n = nodes.filter(in_module(F.col("path"), within) & ~any_glob(F.col("path"), exempt)).select("id", "path")
    p = pairs.filter(F.col("sim") >= threshold).join(n.select(F.col("id").alias("a"), F.col("path").alias("pa")), "a").join(n.select(F.col("id").alias("b"), F.col("path").alias("pb")), "b").filter("pa <> pb")
    files = p.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.max("sim").alias("sim"))
    at = nodes.select("id", "path")
    e = edges.join(at.select(F.col("id").alias("src"), F.col("path").alias("pa")), "src").join(at.select(F.col("id").alias("dst"), F.col("path").alias("pb")), "dst")
    return files.join(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), ["a", "b"], "left_anti")
