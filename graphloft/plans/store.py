"""A versioned store: whole versions in folders, one small pointer file that names the live one.

A version is written beside the live one and becomes live when a pointer with a greater
number than all others gets its name, in one step. A reader follows the greatest pointer,
so it sees one version or the other, and a failed write changes nothing. Old pointers and
versions are removed last.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.schemas import EXTRACTOR_VERSION, SCHEMA_VERSION, GraphTables
from graphloft.storage import names, remove, rename


class StoreError(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> list[str]:
        return [x for x in names(self.spark, self.path) if x.startswith("CURRENT-")]

    def _pointer(self) -> dict | None:
        known = self._pointers()
        if not known:
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/{known[-1]}").collect()))  # one line

    def current(self) -> dict | None:
        """The live version: name, sha, schema and extractor versions; None before the first."""
        p = self._pointer()
        if p and p["schema"] > SCHEMA_VERSION:
            raise StoreError(f"the store has schema {p['schema']}, this engine knows up to {SCHEMA_VERSION}")
        return p

    def publish(self, g: GraphTables, sha: str | None = None, base: str | None = None, keep: int = 3) -> str:
        """Writes all tables as a new version and makes it live; `base` must still be live if it is given."""
        live = self.current()
        if base is not None and (live or {}).get("sha") != base:
            raise StoreError(f"the live version is {(live or {}).get('sha')}, not {base}")
        name = f"v{time.time_ns():020d}"
        for table, df in {"nodes": g.nodes, "edges": g.edges, **g.more}.items():
            df.write.parquet(f"{self.path}/{name}/{table}")
        self._point({"name": name, "sha": sha, "schema": SCHEMA_VERSION, "extractor": EXTRACTOR_VERSION, "tables": ["nodes", "edges", *g.more], "history": [*(live or {}).get("history", []), {"name": name, "sha": sha}]}, keep)
        return name

    def _point(self, to: dict, keep: int) -> None:
        gone, to = to["history"][:-keep], {**to, "history": to["history"][-keep:]}
        before = self._pointers()
        number = 1 + max((int(x.split("-")[1]) for x in before), default=0)
        new = f"{self.path}/NEXT-{time.time_ns()}"
        self.spark.createDataFrame([(json.dumps(to),)], "value string").coalesce(1).write.text(new)
        rename(self.spark, new, f"{self.path}/CURRENT-{number:012d}")
        for old in [*before[:-1], *[x["name"] for x in gone if x["name"] != to["name"]]]:  # a reader may still hold the last pointer
            remove(self.spark, f"{self.path}/{old}")

    def read(self, name: str | None = None) -> GraphTables:
        p = self.current()
        if p is None:
            raise StoreError("nothing was published yet")
        t = {x: self.spark.read.parquet(f"{self.path}/{name or p['name']}/{x}") for x in p["tables"]}
        return GraphTables(t.pop("nodes"), t.pop("edges"), t)

    def restore(self, sha: str) -> bool:
        """Makes a kept version of a commit live again."""
        p = self.current()
        hit = next((h for h in reversed((p or {}).get("history", [])) if h["sha"] == sha), None)
        if hit is None:
            return False
        self._point({**p, "name": hit["name"], "sha": sha}, len(p["history"]))
        return True

    def needs_rebuild(self) -> bool:
        p = self.current()
        return p is None or p["extractor"] != EXTRACTOR_VERSION

    def backup(self, path: str) -> None:
        """A copy of the live version as a store of its own."""
        Store(self.spark, path).publish(self.read(), (self.current() or {}).get("sha"))


class Reader:
    """A view that follows the pointer, polling at most every `interval` seconds; on error the old view stays."""

    def __init__(self, store: Store, interval: float = 0.5):
        self.store, self.interval, self._name, self._view, self._asked = store, interval, None, None, 0.0

    def view(self) -> GraphTables:
        if self._view is None or time.monotonic() - self._asked >= self.interval:
            self._asked = time.monotonic()
            try:
                p = self.store.current()
                if p and p["name"] != self._name:
                    self._view, self._name = self.store.read(), p["name"]
            except StoreError:
                if self._view is None:
                    raise
        if self._view is None:
            raise StoreError("nothing was published yet")
        return self._view


def freshness(stored: str | None, head: str | None, dirty: bool = False) -> str:
    """Fresh, Behind, Dirty or Unknown."""
    if stored is None or head is None:
        return "Unknown"
    return "Behind" if stored != head else "Dirty" if dirty else "Fresh"


def counts(g: GraphTables) -> DataFrame:
    """(table, n) of every table."""
    out = None
    for name, df in {"nodes": g.nodes, "edges": g.edges, **g.more}.items():
        n = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out
