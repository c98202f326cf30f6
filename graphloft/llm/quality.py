"""Quality rules: hashed n-gram log-likelihood ratio, target against raw corpus.

The trusted target is made of documents labelled quality 1; the raw corpus is every
document. Words and word pairs are hashed into ``BUCKETS`` counters. Two smoothed
multinomials follow, and a document's score is the mean over its n-grams of
``log P_target - log P_raw``: normalised by length, so that one threshold serves every
document. Only DataFrame functions are used; the corpus is read once to count and once
to score, and nothing but the counters (at most ``BUCKETS`` rows) reaches the driver.

Each word is hashed once as it stands (windows) and once in lower case (n-grams); pairs
and windows combine these hashes.

Defined cases: a null or blank text has no words, fails the base rules and is not kept;
a row is judged by itself, so repeated rows and null ids get equal verdicts; without
labelled documents the target equals the corpus and every score is 0; an input column
with the name of an added one is left out, and any other name may occur.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.llm.common import SPACE, numbers, table, words

#: Counters of hashed n-grams: the model's size, whatever the corpus.
BUCKETS = 1 << 15
#: Ids of the target's documents up to which their table is sent to every task.
FEW = 1_000_000
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.25
#: Added to each counter.
PRIOR = 0.5
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20


def _bucket(h):
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pairs(array):
    """Each element with the next one; the last has null beside it."""
    return F.arrays_zip(array.alias("a"), F.slice(array, F.lit(2), F.size(array)).alias("b"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the target's documents: all that are labelled good."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, few: int = FEW) -> list[float]:
    """Log ratio of each bucket, from counts over all of docs and all that are labelled good."""
    target = trusted_ids(labels)
    small = target.count() <= few
    target = target.withColumn("is_target", F.lit(1))
    target = F.broadcast(target) if small else target
    # a row for each word and its successor; hashing is compiled code there, and counts are summed in each task
    each = docs.select("doc_id", "text").join(target, "doc_id", "left").select("is_target", F.explode(_pairs(words(F.lower("text")))).alias("x"))
    two = F.when(F.col("x.b").isNotNull(), _bucket(F.xxhash64(F.xxhash64("x.a"), F.xxhash64("x.b"))))
    counted = (
        each.select("is_target", F.explode(F.array(_bucket(F.xxhash64("x.a")), two)).alias("bucket")).filter("bucket IS NOT NULL")
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("is_target").alias("target"))
        .collect()
    )
    raw, aim = [0] * BUCKETS, [0] * BUCKETS
    for r in counted:
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["target"]
    if not sum(aim):
        return [0.0] * BUCKETS
    n, m = sum(raw) + PRIOR * BUCKETS, sum(aim) + PRIOR * BUCKETS
    # An n-gram that the target lacks says less when the target is small: both get the same prior, scaled to their size.
    rate = m / n
    # to four decimals: the table is part of the query's plan
    return [round(math.log((a + PRIOR) / m) - math.log((r * 1.0 + PRIOR / rate) / (n + (PRIOR / rate - PRIOR) * BUCKETS)), 4) for r, a in zip(raw, aim)]


#: Columns that judge() adds; columns of the input that have these names are left out.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "score", "kept")


def _without(text, characters: str):
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _judged(docs: DataFrame, model: list[float], threshold: float) -> DataFrame:
    """Columns c0, c1, ... of docs in order, then ADDED."""
    ratio, own = numbers(model), [f"c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(own[docs.columns.index("text")]), F.lit(""))
    lines = F.when(F.contains(text, F.lit("\n")), F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0))
    hashes = lambda x: F.transform(words(x), lambda w: F.xxhash64(w))
    a = docs.toDF(*own).select(*own, words(text).alias("ws"), hashes(F.lower(text)).alias("low"), lines.alias("lines"))
    b = a.withColumn("h", F.transform("ws", lambda w: F.xxhash64(w)))
    window = F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, WINDOW)]))
    c = b.withColumn("h", F.slice(window, F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))))
    ordered = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # sorted by (hash, place): a window is repeated if a neighbour has its hash
    d = c.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered))
    like = lambda x, i: F.coalesce(F.get("s", i)["h"] == x["h"], F.lit(False))
    e = d.withColumn("at", F.array_sort(F.transform(F.filter("s", lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    gram = lambda a, b: F.get(ratio, _bucket(a)) + F.when(b.isNull(), 0.0).otherwise(F.get(ratio, _bucket(F.xxhash64(a, b))))
    total = F.aggregate(F.zip_with("low", F.slice("low", F.lit(2), F.size("low")), gram), F.lit(0.0), lambda s, x: s + x)
    f = e.select(
        *own,
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (total / F.greatest(2 * F.size("low") - 1, F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    g = f.withColumn("base_failed", failed)
    return g.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(*own, *ADDED)


def judge(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, score and kept."""
    out = _judged(docs, model, threshold)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED], *ADDED)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), model).select("doc_id", *BASE, "base_failed", "score", "kept")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that the rules keep."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    # A plain filter would be pushed below the verdict, with every step of it written out
    # again inside its condition; rows leave through a generator instead.
    own = [f"c{i}" for i in range(len(docs.columns))]
    row = F.explode_outer(F.when(F.col("kept"), F.array(F.struct(*own))))
    return _judged(docs, model, THRESHOLD).select(row.alias("row")).filter("row IS NOT NULL").select("row.*").toDF(*docs.columns)
