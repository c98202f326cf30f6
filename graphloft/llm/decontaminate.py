"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words is one window).
A window is the sequence of its shingles, of ``SHINGLE`` words each. Documents keep only
the shingles that some window has; counting those over all documents gives their rarity.
Each window is then found through its rarest shingle alone (the prefix that containment
needs), its place in the document follows from the shingle's offset (positional bound),
must fit between the text's ends (length bound), and is verified by the presence of every
other shingle of the window at its own place: exact containment of all words.

Windows with equal words are one, and a window with a shingle that no document has is out
before the join. The shingles of the benchmark are broadcast up to ``FEW`` of them
(counted first); beyond that the same join shuffles.

Defined cases: null and blank texts have no words, as documents or as items; repeated
documents get equal rows each; items with equal ids count once, a null id has the name
''; with an empty benchmark nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloft.llm.common import lower_ascii, stage, table

#: What separates words, and the words of a window.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Shingles of the benchmark that may be sent to every task.
FEW = 400_000


def word_list(text):
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), "")


def shingles(ws, k: int):
    """Array of ws's runs of k words, each as one string; words hold no spaces."""
    at = F.sequence(F.lit(1), F.size(ws) - (k - 1))
    return F.when(F.size(ws) >= k, F.transform(at, lambda i: F.array_join(F.slice(ws, i, k), " ")))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, len, k, item): the distinct windows, by the words joined, with their items."""
    a = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_list(F.col("text")).alias("ws")).filter("size(ws) > 0")
    n = F.least(F.lit(window), F.size("ws"))
    b = a.select("item", "ws", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("i"))
    return b.select("item", "len", F.least(F.lit(SHINGLE), F.col("len")).alias("k"), F.array_join(F.slice("ws", F.col("i"), F.col("len")), " ").alias("win")).distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, t, start, len, win, n): each window's occurrences; d and t stand for the row."""
    spark = docs.sparkSession
    wins = stage(windows(items, window), "leak-win")
    ks = sorted(r["k"] for r in wins.select("k").distinct().collect())  # SHINGLE values at most
    part = None
    for k in ks:
        p = wins.filter(F.col("k") == k).select("win", "len", "k").distinct().select("win", "len", "k", F.posexplode(shingles(F.split("win", " "), k)).alias("off", "sh"))
        part = p if part is None else part.unionByName(p)
    if part is None:
        return spark.createDataFrame([], "d long, t long, start int, len int, win string, n int")
    part = stage(part, "leak-part")
    known = part.select("sh").distinct()
    known = F.broadcast(known) if known.count() <= FEW else known
    ws = docs.select(*row_key(), word_list(F.col("text")).alias("ws"))
    each = None
    for k in ks:
        e = ws.select("d", "t", F.size("ws").alias("n"), F.posexplode(shingles(F.col("ws"), k)).alias("pos", "sh"))
        each = e if each is None else each.unionByName(e)
    seen = stage(each.join(known, "sh").dropDuplicates(["d", "t", "pos", "sh"]), "leak-seen")
    rare = seen.groupBy("sh").agg(F.count(F.lit(1)).alias("freq"))
    ranked = part.join(rare, "sh", "left").withColumn("gone", F.max(F.col("freq").isNull()).over(Window.partitionBy("win")))
    ranked = stage(ranked.filter("NOT gone").drop("gone"), "leak-rank")
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("win").orderBy("freq", "sh", "off"))).filter("r = 1").select("win", "len", "k", "off", "sh")
    start = F.col("pos") - F.col("off")
    cand = seen.join(first, "sh").select("d", "t", "n", "win", "len", "k", start.alias("start")).filter("start >= 0 AND start + len <= n")
    need = cand.join(ranked.select("win", "off", "sh"), "win").withColumn("pos", F.col("start") + F.col("off"))
    return (
        need.join(seen.select("d", "t", "pos", "sh"), ["d", "t", "pos", "sh"])
        .groupBy("d", "t", "win", "len", "k", "start", "n").agg(F.count(F.lit(1)).alias("c")).filter("c = len - k + 1")
        .select("d", "t", "start", "len", "win", "n")
    )


def row_key() -> list:
    """What a row is known by: its id and its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t")]


def spoiled(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, t, n_hit, items): documents that hold windows, with hit words and item ids."""
    found = stage(hits(docs, items, window), "leak-hit")
    spans = found.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("s"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum"))
    n_hit = F.aggregate("s", zero, lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), (a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["at"], x["start"]))).alias("sum")))["sum"]
    names = found.select("d", "t", "win").distinct().join(windows(items, window).select("win", "item"), "win").groupBy("d", "t").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.select("d", "t", n_hit.cast("long").alias("n_hit")).join(names, ["d", "t"])


def check(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs' (doc_id, n_words) with n_hit and items."""
    bad = spoiled(docs, items, window)
    a = docs.select("doc_id", *row_key(), F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    return a.join(bad, ["d", "t"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = check(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents without any benchmark window."""
    bad = spoiled(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("d", "t")
    own = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of the input clashes
    keyed = docs.select("*", *row_key()).toDF(*own, "d", "t")
    return keyed.join(bad, ["d", "t"], "left_anti").select(*own).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[i : i + l - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
h AS (
  SELECT DISTINCT doc_id, i, l, win FROM (
    SELECT doc_id, i, l, array_to_string(ws[i : i + l - 1], ' ') AS win FROM p, (SELECT DISTINCT l FROM w) WHERE i + l - 1 <= len(ws))
  WHERE win IN (SELECT win FROM w)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM h) GROUP BY 1),
m AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT h.doc_id, CAST(w.item_id AS VARCHAR) AS item FROM h JOIN w USING (win)) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
