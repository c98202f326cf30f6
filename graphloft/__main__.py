"""Command line: index a folder, then query, search, report, review and verify it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from graphloft.api import Engine
from graphloft.operators.filters import Identity
from graphloft.operators.gates import EXIT
from graphloft.plans.query import QueryError
from graphloft.plans.store import Store
from graphloft.sources.files import build, discover, extract


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloft", description=__doc__)
    p.add_argument("--store", default=".graphloft")
    p.add_argument("--roles", default="")
    sub = p.add_subparsers(dest="verb", required=True)

    def add(name, *args):
        own = sub.add_parser(name)
        for names, more in args:
            own.add_argument(*names, **more)

    add("index", (("root",), {}), (("--sha",), {}))
    add("status")
    add("query", (("text",), {}))
    add("ask", (("question",), {}))
    add("search", (("text",), {}), (("--limit",), {"type": int, "default": 20}), (("--semantic",), {"action": "store_true"}))
    add("find-all", (("text",), {}))
    add("report")
    add("canvas")
    add("export", (("symbol",), {}), (("--depth",), {"type": int, "default": 1}))
    add("blast", (("paths",), {"nargs": "+"}), (("--direction",), {"default": "callers"}), (("--depth",), {"default": "2"}))
    add("review", (("paths",), {"nargs": "+"}), (("--rules",), {}), (("--fail-on",), {"default": "blocker"}))
    add("policy", (("rules",), {}))
    add("verify", (("paths",), {"nargs": "*"}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloft").getOrCreate()
    store = Store(spark, a.store)
    if a.verb == "index":
        print(store.publish(build(extract(discover(spark, a.root))), a.sha))
        return 0
    if a.verb == "status":
        print(json.dumps(store.current()))
        return 0
    roles = tuple(r for r in a.roles.split(",") if r)
    e = Engine(store.read(), Identity(roles) if roles else None)
    load = lambda path: json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())) if path else []
    try:
        if a.verb == "query":
            e.query(a.text).show(1000, False)
        elif a.verb == "ask":
            e.ask(a.question).show(1000, False)
        elif a.verb == "search":
            (e.search_semantic if a.semantic else e.search)(a.text, a.limit).show(100, False)
        elif a.verb == "find-all":
            e.find_all(a.text).show(1000, False)
        elif a.verb == "report":
            print(e.report())
        elif a.verb == "canvas":
            print(e.canvas())
        elif a.verb == "export":
            print(e.neighborhood_json(a.symbol, a.depth))
        elif a.verb == "blast":
            e.blast(a.paths, a.direction, a.depth).show(1000, False)
        elif a.verb == "policy":
            bad = e.policy_lint(load(a.rules))
            bad.show(100, False)
            return int(not bad.isEmpty())
        elif a.verb == "review":
            r = e.review(a.paths, load(a.rules), fail_on=a.fail_on)
            print(json.dumps(r.__dict__, indent=2))
            return int(r.failed)
        elif a.verb == "verify":
            v = e.verify(a.paths or None)
            print(v)
            return EXIT[v]
    except QueryError as err:
        print(err, *err.suggestions, sep="\n  ", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
