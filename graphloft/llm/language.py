"""Language ID: Bayesian fusion of text, markup, address and host.

For each page and language the log posterior is the sum of

* the text's log likelihood under a smoothed multinomial over hashed words (learnt from all
  documents of known language), tempered by ``TEMPER`` since words of one text are not
  independent;
* the likelihood of the language that the markup declares, and of the one that the address
  names (its path or suffix), each from a table of counts;
* the host's prior: its own counts smoothed by its domain's, and these by all pages'.

The count tables come from grouped aggregations over all pages, in which each page counts
for the language that its text alone speaks for. They are as large as there are hosts and
are joined, never collected; the tables of markup and address are small, one row for each
declared value, and only values that name a known language are kept apart.

Defined cases: a page without text is judged by the rest; no declaration and no address
are values of their own; a null url has the host ''; without documents of known language
the result is 'und' for every page; repeated rows count as often as they stand; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.llm.common import SPACE, lower_ascii, numbers, stage, table

#: Counters of hashed words.
BUCKETS = 1 << 14
TEMPER, PRIOR = 0.25, 0.5
#: Pages that the next level of the host's hierarchy counts for.
STRENGTH = 5.0


def _buckets(text: Column) -> Column:
    ws = F.array_remove(F.split(F.regexp_replace(lower_ascii(text), r"[\x00-\x60\x7B-\x7F]+", " "), SPACE), "")
    return F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def plain(html: Column) -> Column:
    """A page's visible text."""
    a = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(a, r"&#?[A-Za-z0-9]+;", " ")


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Log probability of each bucket, by language, from counts over all of docs."""
    known = docs.filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
    counted = known.select("lang", F.explode(_buckets(F.col("text"))).alias("b")).groupBy("lang", "b").count().collect()  # languages x BUCKETS
    out: dict[str, list[float]] = {}
    for r in counted:
        out.setdefault(r["lang"], [PRIOR] * BUCKETS)[r["b"]] += r["count"]
    return {lang: [math.log(x / t) for x in c] for lang, c in sorted(out.items()) for t in [sum(c)]}


def _log_likelihood(buckets: Column, logs: list[float]) -> Column:
    table_ = numbers(logs)
    return F.lit(TEMPER) * F.aggregate(buckets, F.lit(0.0), lambda s, x: s + F.get(table_, x))


def identify(pages: DataFrame, model: dict[str, list[float]]) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, address, host) of each page."""
    langs = list(model)
    known = F.array(*[F.lit(x) for x in langs])
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    declared = F.lower(F.substring(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1), 1, 2))
    suffix, part = F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:/|$)", 1)
    named = lambda c: F.when(F.array_contains(known, c), c).otherwise("")
    address = F.when(named(part) != "", part).otherwise(named(suffix))
    if not langs:
        return pages.select("page_id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), declared.alias("declared"), F.lit("").alias("address"), host.alias("host"))
    a = pages.select("page_id", host.alias("host"), named(declared).alias("declared"), address.alias("address"), _buckets(plain(F.col("html"))).alias("b"))
    a = a.withColumn("domain", F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1))
    lik = [_log_likelihood(F.col("b"), model[k]) for k in langs]
    a = a.select("page_id", "host", "domain", "declared", "address", F.array(*lik).alias("lik"))
    a = stage(a.withColumn("guess", F.when(F.array_min("lik") < F.array_max("lik"), F.array_position("lik", F.array_max("lik")).cast("int"))), "lang-page")
    votes = lambda *keys: a.groupBy(*keys).agg(F.array(*[F.count_if(F.col("guess") == i + 1).cast("double") for i in range(len(langs))]).alias("v"))
    total = F.lit(1.0 * len(langs))
    share = lambda v, up, k: F.zip_with(v, up, lambda x, y: (x + k * y) / (F.aggregate(v, F.lit(0.0), lambda s, t: s + t) + k))
    every = votes().select(F.transform("v", lambda x: (x + 1.0) / (F.aggregate("v", F.lit(0.0), lambda s, t: s + t) + total)).alias("p")).first()["p"]
    base = F.array(*[F.lit(float(x)) for x in every])
    domains = votes("domain").select("domain", share(F.col("v"), base, STRENGTH).alias("pd"))
    hosts = votes("host", "domain").join(domains, "domain").select("host", share(F.col("v"), F.col("pd"), STRENGTH).alias("prior"))
    out = a.join(hosts, "host", "left")
    for name in ("declared", "address"):  # at most languages + 1 rows each
        seen = {r[name]: list(r["v"]) for r in votes(name).collect()}
        sums = [sum(v[i] for v in seen.values()) for i in range(len(langs))]
        table_ = F.array(*[F.lit(0.0)] * len(langs))
        for value in sorted(seen):
            table_ = F.when(F.col(name) == value, F.array(*[F.lit(math.log((seen[value][i] + PRIOR) / (sums[i] + PRIOR * (len(langs) + 1)))) for i in range(len(langs))])).otherwise(table_)
        out = out.withColumn(f"l_{name}", table_)
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    post = add(add(F.col("lik"), F.col("l_declared")), add(F.col("l_address"), F.transform("prior", lambda p: F.log(p))))
    out = out.withColumn("post", post).withColumn("top", F.array_max("post"))
    norm = F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    name = lambda i: F.get(known, i - 1)
    return out.select("page_id", name(F.array_position("post", F.col("top")).cast("int")).alias("lang"), (1.0 / norm).alias("confidence"), F.coalesce(name(F.col("guess")), F.lit("und")).alias("text_lang"), "declared", "address", "host")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))
