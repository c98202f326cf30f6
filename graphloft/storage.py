"""Shared storage: staged tables that cut lineage, in the folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where nothing is named a temporary folder is made once for the session's context, on one
    machine (tests) only: executors elsewhere would each see a folder of their own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    own = getattr(spark.sparkContext, "_graphloft_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="graphloft-")
        spark.sparkContext._graphloft_shared = own
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Where set, a query's shuffle files go when the query ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what is written leaves no shuffle files behind: nothing reads them again."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloft_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what stage() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_graphloft_path", None)
    if path:
        remove(df.sparkSession, path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a folder to a place where nothing is yet."""
    fs, where = _fs(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if it is not there."""
    fs, where = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def found(spark: SparkSession, root: str, names: tuple[str, ...]) -> list[str]:
    """Paths below root, relative to it, of files and folders with one of the names; only listings are read."""
    fs, where = _fs(spark, root)
    top, at, out = fs.makeQualified(where).toUri().getPath().rstrip("/") + "/", fs.listFiles(where, True), set()
    while at.hasNext():
        parts = at.next().getPath().toUri().getPath().removeprefix(top).split("/")
        out.update("/".join(parts[: i + 1]) for i, x in enumerate(parts) if x in names)
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any store, read on the driver."""
    fs, where = _fs(spark, path)
    size = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(size)).decode("utf-8", "replace")
    finally:
        stream.close()
