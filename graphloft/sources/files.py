"""Source files as tables: discovery, extraction, and the graph they make."""

from __future__ import annotations

import hashlib
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.extract.scan import MODULE, markdown, parse, routes
from graphloft.functions.languages import language, language_of
from graphloft.operators.resolve import CALLS, resolve_refs, unresolved
from graphloft.schemas import GraphTables
from graphloft.shipping import ship
from graphloft.sources.ignore import ignored, rules
from graphloft.storage import found, read_text, stage

# Folders that hold no sources, and files that mark an environment's folder.
SKIP = ("target", "node_modules", ".git", "dist", "build", "graft")
MARKERS = ("pyvenv.cfg", "conda-meta")
IGNORE = (".gitignore", ".ignore")
SYMBOL = "struct<symbol:string,kind:string,line_start:int,line_end:int,signature:string>"
PARSED = f"repo_id string, path string, symbols array<{SYMBOL}>, calls array<struct<source:string,name:string,is_member:boolean>>, structure array<struct<source:string,name:string,kind:string>>, routes array<struct<route:string,handler:string,line:int>>, error string"


def discover(spark: SparkSession, root: str, include_dotfiles: bool = False, exclude=()) -> DataFrame:
    """(path, text) of the source files below root, with paths relative to it.

    Files and folders that ignore files (``.gitignore``, ``.ignore``) leave out are not taken,
    and of files that are not taken no content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/").replace("file:", "")) + "/", "")
    f = raw.select(rel.alias("path"), F.col("content"))
    part = F.split("path", "/")
    dirs = [x.rpartition("/")[0] for x in found(spark, root, MARKERS) if "/" in x]  # environments, a handful
    # Spark does not list names that begin with a dot, so ignore files are looked up by name and read as text
    known = [x for name in found(spark, root, IGNORE) for x in rules(name.rpartition("/")[0], read_text(spark, f"{root.rstrip('/')}/{name}"))]
    keep = ~F.exists(F.slice(part, F.lit(1), F.size(part) - 1), lambda x: x.isin(*SKIP)) & ~ignored(F.col("path"), known)
    if not include_dotfiles:
        keep = keep & ~F.exists(part, lambda x: x.startswith("."))
    for d in [*dirs, *exclude]:
        keep = keep & ~((F.col("path") == d) | F.col("path").startswith(d.rstrip("/") + "/"))
    return f.filter(keep & (language(F.col("path")).isNotNull() | F.lower("path").endswith(".md"))).select("path", F.col("content").cast("string").alias("text"))


def extract(files: DataFrame, repo_id: str = "repo", with_routes: bool = False) -> DataFrame:
    """A row for each file with its symbols and raw references; a file that fails is kept with its error."""
    ship(files.sparkSession)

    def work(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                lang, bad = language_of(path), None
                try:
                    p = parse(lang, text or "")
                    r = routes(lang, text or "") if with_routes else []
                except (RecursionError, ValueError, IndexError) as e:
                    p, r, bad = parse(None, ""), [], str(e)
                rows.append((repo_id, path, [dict(zip(("symbol", "kind", "line_start", "line_end", "signature"), s)) for s in p.symbols], [dict(zip(("source", "name", "is_member"), c)) for c in p.calls], [dict(zip(("source", "name", "kind"), s)) for s in p.structure], [dict(zip(("route", "handler", "line"), x)) for x in r], bad))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "symbols", "calls", "structure", "routes", "error"])

    return files.select("path", "text").mapInPandas(work, PARSED)


def _ids(nodes: DataFrame) -> DataFrame:
    """Staged nodes, numbered from 1 by place: each part of the sorted table from where the parts before it end."""
    order = F.monotonically_increasing_id()  # the part, and the row in it
    n = stage(nodes.orderBy("repo_id", "path", "line_start", "symbol").withColumn("_at", order), "nodes")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in n.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each part
    before = dict(zip([p for p, _ in sizes], itertools.accumulate((k for _, k in sizes), initial=0)))
    starts = nodes.sparkSession.createDataFrame(list(before.items()), "_part long, _start long")
    n = n.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return n.withColumn("id", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)


def build(parsed: DataFrame, module_nodes: bool = False) -> GraphTables:
    """Nodes, edges, raw refs and unresolved names of extracted files.

    References from a file's top level have no symbol to start from and are dropped (their
    unresolved names are not), unless module_nodes asks for one symbol per file. What was parsed is
    staged: no file is parsed twice, and joins are planned by the size of symbols, not of sources.
    """
    parsed = stage(parsed, "parsed")
    s = parsed.select("repo_id", "path", F.explode("symbols").alias("s")).select("repo_id", "path", "s.*")
    r = parsed.select("repo_id", "path", F.explode("routes").alias("r")).select("repo_id", "path", F.col("r.route").alias("symbol"), F.lit("route").alias("kind"), F.col("r.line").alias("line_start"), F.col("r.line").alias("line_end"), F.col("r.route").alias("signature"))
    s = s.unionByName(r)
    if module_nodes:
        s = s.unionByName(parsed.select("repo_id", "path", F.lit(MODULE).alias("symbol"), F.lit("module").alias("kind"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("").alias("signature")))
    nodes = _ids(s.dropDuplicates(["repo_id", "path", "symbol", "line_start"])).select("id", "repo_id", "path", "symbol", "kind", "line_start", "line_end", "signature")
    calls = parsed.select("repo_id", "path", F.explode("calls").alias("c")).select("repo_id", "path", "c.source", "c.name", F.lit(CALLS).alias("kind"), "c.is_member")
    more = parsed.select("repo_id", "path", F.explode("structure").alias("c")).select("repo_id", "path", "c.source", "c.name", "c.kind", F.lit(False).alias("is_member"))
    to = parsed.select("repo_id", "path", F.explode("routes").alias("c")).select("repo_id", "path", F.col("c.route").alias("source"), F.col("c.handler").alias("name"), F.lit("ROUTES_TO").alias("kind"), F.lit(False).alias("is_member"))
    refs = calls.unionByName(more).unionByName(to)
    first = nodes.groupBy("repo_id", "path", F.col("symbol").alias("source")).agg(F.min("id").alias("src"))
    edges = resolve_refs(refs.join(first, ["repo_id", "path", "source"]), nodes)
    return GraphTables(nodes, edges, {"raw_refs": refs, "unresolved_refs": unresolved(refs, nodes)})


def notes(files: DataFrame) -> DataFrame:
    """(path, tags, aliases, links, headings, code_refs) of Markdown files."""
    ship(files.sparkSession)
    schema = "path string, tags array<string>, aliases array<string>, links array<struct<section:string,target:string>>, headings array<struct<title:string,level:int,line:int>>, code_refs array<struct<section:string,text:string>>"

    def work(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                m = markdown(text or "")
                rows.append((path, m["tags"], m["aliases"], [dict(section=a, target=b) for a, b in m["links"]], [dict(title=a, level=b, line=c) for a, b, c in m["headings"]], [dict(section=a, text=b) for a, b in m["code_refs"]]))
            yield pd.DataFrame(rows, columns=["path", "tags", "aliases", "links", "headings", "code_refs"])

    return files.filter(F.lower("path").endswith(".md")).select("path", "text").mapInPandas(work, schema)


def span_hash(text: str) -> str:
    """The digest of a symbol's text that notes are compared by."""
    return hashlib.sha256(text.encode()).hexdigest()


def spans_text(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, body, doc_comment): each symbol's lines, and the run of comment lines above it."""
    lines = F.split("text", "\n")
    j = nodes.join(files.select("path", lines.alias("lines")), "path")
    above = F.reverse(F.slice("lines", 1, F.greatest(F.col("line_start") - 1, F.lit(0))))
    stop = F.array_position(F.transform(above, lambda x: F.trim(x).rlike(r"^(//|#|--|\*|/\*|;|%)")), False)
    run = F.when(stop == 0, above).otherwise(F.slice(above, 1, stop.cast("int") - 1))
    return j.select("id", F.array_join(F.slice("lines", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "\n").alias("body"), F.array_join(F.reverse(run), "\n").alias("doc_comment"))
