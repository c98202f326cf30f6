"""The graph of many extracted files: ids by place, each file parsed once, plans that know the size of the symbols."""

from pyspark.sql import functions as F

from graphloft.sources import files


def test_files_are_parsed_once_and_ids_follow_places(spark):
    some = spark.range(0, 300, 1, 7).select(F.concat(F.lit("src/"), F.col("id") % 150, F.when(F.col("id") < 150, ".py").otherwise(".rs")).alias("path"), F.when(F.col("id") < 150, "def b():\n    return a()\n\n\ndef a():\n    return 1\n").otherwise("fn b() {\n    a();\n}\n\nfn a() {\n}\n").alias("text"))
    g = files.build(files.extract(some))
    rows = [tuple(r) for r in g.nodes.select("repo_id", "path", "line_start", "symbol", "id").collect()]
    assert [r[-1] for r in sorted(rows)] == list(range(1, 601))
    for df in (g.nodes, g.edges, g.unresolved_refs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "SinglePartition" not in plan
    ids = {(r[1], r[3]): r[4] for r in rows}
    assert {(r["src"], r["dst"], r["kind"]) for r in g.edges.collect()} == {(ids[p, "b"], ids[p, "a"], "CALLS_EXACT") for p, s in ids if s == "b"}


def test_no_files_make_an_empty_graph(spark):
    g = files.build(files.extract(spark.createDataFrame([], "path string, text string")))
    assert g.nodes.count() == 0 and g.edges.count() == 0
