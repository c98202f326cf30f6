"""What a version control tool prints, as tables: changed files, submodules and their states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_files(*listings: DataFrame) -> DataFrame:
    """(path) of listings (value) with one name in a line: tracked changes, and new files; each once."""
    out = listings[0].select("value")
    for more in listings[1:]:
        out = out.unionByName(more.select("value"))
    return out.select(F.explode(F.split("value", r"\r?\n")).alias("path")).filter("path <> ''").distinct()


def submodules(texts: DataFrame) -> DataFrame:
    """(file, name, path) of module files (file, text): each path with the section that it stands in."""
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    name = F.regexp_extract("line", r'^\[submodule "(.*)"\]$', 1)
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("name", F.last(F.when(name != "", name), ignorenulls=True).over(w))
    path = F.regexp_extract("line", r"^path\s*=\s*(.*)$", 1)
    return own.filter((path != "") & F.col("name").isNotNull()).select("file", "name", path.alias("path"))


def submodule_states(modules: DataFrame, status: DataFrame, dirty: DataFrame) -> DataFrame:
    """modules (name, path) with their state: status lines (value) begin with a mark, dirty (path) have local changes."""
    line = status.select(F.substring("value", 1, 1).alias("mark"), F.regexp_extract("value", r"^.[0-9a-f]+ (\S+)", 1).alias("path"))
    a = modules.join(line, "path", "left").join(dirty.select("path", F.lit(True).alias("dirty")).distinct(), "path", "left")
    state = F.when(F.col("mark") == "-", "uninitialized").when(F.col("mark").isin("U", "+"), "bumped").when(F.col("dirty"), "dirty").otherwise("clean")
    return a.select("name", "path", state.alias("state"))
