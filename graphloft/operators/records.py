"""Notes, trace spans, documentation links, journal and review history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloft.functions.text import code_ref, dir_of, moniker, short_name, stem_of
from graphloft.operators.mutation import upsert
from graphloft.operators.traverse import reachable_within

# Note tiers, and how long an ephemeral note lasts.
EPHEMERAL, CRYSTALLIZED, TTL_SECONDS = "ephemeral", "crystallized", 24 * 3600


def tier(text: Column) -> Column:
    """A note's tier; unknown text is crystallized."""
    return F.when(text == EPHEMERAL, EPHEMERAL).otherwise(CRYSTALLIZED)


def pin(notes: DataFrame, pins: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """notes with new ones pinned to symbols; pins: (path, symbol, kind, tier, author, content, content_hash).

    A note gets its symbol's id and moniker; an ephemeral one lasts TTL_SECONDS. Ids go on
    from the greatest, in order of moniker and content. A pin to no symbol is left out.
    """
    at = nodes.groupBy("path", "symbol").agg(F.min("id").alias("target_node_id"))
    a = pins.join(at, ["path", "symbol"]).withColumns({"moniker": moniker(F.col("path"), F.col("symbol")), "tier": tier(F.col("tier"))})
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    nth = F.row_number().over(Window.partitionBy().orderBy("moniker", "content"))
    lasts = F.when(F.col("tier") == EPHEMERAL, F.lit(now + TTL_SECONDS).cast("long"))
    a = a.withColumns({"nth": nth, "stale": F.lit(False), "expires_at": lasts, "created_at": F.lit(now).cast("long")}).join(top)
    return notes.unionByName(a.withColumn("id", F.col("top") + F.col("nth")).select(*notes.columns))


def put_spans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spans with new ones in place of those with the same trace and span ids."""
    return upsert(old, new, ("trace_id", "span_id"))


def spans_of(spans: DataFrame, symbol: str) -> DataFrame:
    """A symbol's spans, oldest first."""
    return spans.filter(F.col("symbol") == symbol).orderBy("start_us", "span_id")


def put_doc_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documentation links with new ones in place of those between the same ends."""
    return upsert(old, new, ("doc_id", "section", "target_node_id", "kind"))


def signed_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, target, section, kind, provenance...) of links that carry a signature, with their symbols' names."""
    names = nodes.select("id", "symbol")
    a = links.filter("provenance_signature IS NOT NULL").join(names.toDF("doc_id", "doc"), "doc_id", "left").join(names.toDF("target_node_id", "target"), "target_node_id", "left")
    return a.select("doc", "target", "section", "kind", "provenance_commit", "provenance_hash", "provenance_signature")


def append_review(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """History with new reviews (without id) after the last one, in order of time."""
    top = reviews.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    nth = F.row_number().over(Window.partitionBy().orderBy("created_at", "base", "head"))
    return reviews.unionByName(new.withColumn("nth", nth).join(top).withColumn("id", F.col("top") + F.col("nth")).select(*reviews.columns))


def recall(notes: DataFrame, now) -> DataFrame:
    """Notes still valid: crystallized, or expiring after now."""
    return notes.filter((F.col("tier") == CRYSTALLIZED) | (F.col("expires_at") > now))


def expired(notes: DataFrame, now) -> DataFrame:
    """Notes to delete: ephemeral, and expired by now."""
    return notes.filter((F.col("tier") == EPHEMERAL) & (F.col("expires_at") <= now))


def reattach(notes: DataFrame, nodes: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """notes with target ids found anew by moniker; stale where the symbol is gone or its text changed."""
    n = nodes.groupBy(moniker(F.col("path"), F.col("symbol")).alias("moniker")).agg(F.min("id").alias("_id"))
    out = notes.join(n, "moniker", "left")
    stale = F.col("_id").isNull()
    if hashes is not None:
        out = out.join(hashes.select("moniker", F.col("content_hash").alias("_h")), "moniker", "left")
        stale = stale | F.coalesce(F.col("content_hash") != F.col("_h"), F.lit(False))
    return out.withColumn("target_node_id", F.col("_id")).withColumn("stale", stale).select(*notes.columns)


def attach_spans(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """spans (name, code_function) with symbol: the function named by an attribute if it is known, else by the span's name."""
    known = nodes.select("symbol").distinct()
    a = spans.join(known.select(F.col("symbol").alias("_f")), F.col("code_function") == F.col("_f"), "left")
    b = a.join(known.select(F.col("symbol").alias("_n")), F.col("name") == F.col("_n"), "left")
    return b.withColumn("symbol", F.coalesce("_f", "_n")).drop("_f", "_n")


def doc_edges(docs: DataFrame, notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, section, target, kind) of documents' links.

    docs: (doc_id, path, section, link, code, tag), one row for each link, code reference
    or tag. A wiki link leads to every note of that title. A code reference leads to the
    symbol of that full name, else of that short name; of several, only to one in the
    reference's own folder if there is exactly one.
    """
    titled = notes.select(F.col("id").alias("target"), F.lower(stem_of(F.col("path"))).alias("title"))
    links = docs.filter("link IS NOT NULL").join(titled, F.lower(F.regexp_replace("link", r"[|#].*$", "")) == F.col("title")).select("doc_id", "section", "target", F.lit("LINKS_TO").alias("kind"))
    r = docs.filter("code IS NOT NULL").select("doc_id", "path", "section", code_ref(F.col("code")).alias("ref")).distinct()
    full = nodes.select(F.col("symbol").alias("ref"), F.col("id").alias("target"), F.col("path").alias("tp"))
    exact = r.join(full, "ref")
    rest = r.join(full.select("ref").distinct(), "ref", "left_anti").join(nodes.select(short_name(F.col("symbol")).alias("ref"), F.col("id").alias("target"), F.col("path").alias("tp")), "ref")
    w = Window.partitionBy("doc_id", "section", "ref")
    near = dir_of(F.col("tp")) == dir_of(F.col("path"))
    c = exact.unionByName(rest).withColumn("near", near).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("m", F.sum(near.cast("int")).over(w))
    code = c.filter("n = 1 OR (m = 1 AND near)").select("doc_id", "section", "target", F.lit("EXPLAINS_RATIONALE").alias("kind"))
    return links.unionByName(code).distinct()


def journal(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(touched symbols, what they lead to, documents that refer to either) of changed files."""
    touched = nodes.join(changed.select("path").distinct(), "path", "left_semi")
    code = edges.filter(~F.col("kind").isin("LINKS_TO", "EXPLAINS_RATIONALE", "TAGGED"))
    reach = reachable_within(code, touched.select("id")).select("id", "level")
    about = edges.filter(F.col("kind") == "EXPLAINS_RATIONALE").join(reach.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return touched, reach, nodes.join(about, "id", "left_semi")


def history(reviews: DataFrame, limit: int = 20) -> DataFrame:
    """Newest reviews first."""
    return reviews.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def adr_rules(texts: DataFrame) -> DataFrame:
    """(path, line, text): lines of Markdown that oblige, outside code fences."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    fence = F.ltrim("text").rlike(r"^(```|~~~)")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(fence.cast("int")).over(w) % 2 == 1
    duty = F.lower("text").rlike(r" must | must not | must never | should never ")
    return lines.withColumn("inside", inside).filter(~F.col("inside") & ~fence & duty).select("path", (F.col("line") + 1).alias("line"), F.trim("text").alias("text"))
