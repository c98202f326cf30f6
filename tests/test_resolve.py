"""Resolution where very many symbols and references share a name: SQL's rows, and no candidate pair in a shuffle."""

from collections import Counter

import pytest

from graphloft.operators import resolve
from graphloft.plans.registry import ORACLE, QUERIES

PARTS = 1_500


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Parts of nearly one name (about a million pairs), among them names of one symbol, names of one file, no name and no file."""
    at = str(tmp_path_factory.mktemp("hot"))
    name = lambda i: None if i % 97 == 0 else f"solo{i} solo{i}" if i % 50 == 1 else f"pair{i // 2} pair{i // 2}" if i % 50 < 10 else "hot hot"
    rows = [(i, name(i), None if i % 101 == 0 else f"Brand#{10 + i % 9}", i % 50) for i in range(PARTS)]
    rows += [(7, "hot cold", "Brand#12", 3), (1_001, "cold hot", "Brand#12", 4)]  # ids of several symbols
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    return at


def expected(at, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{at}/part.parquet/*.parquet')")
    rows = con.execute(ORACLE[name])
    return [c[0] for c in rows.description], Counter(rows.fetchall())


def shuffled(df):
    """Rows that all shuffles of a query that has run wrote."""
    seen, total, todo = set(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            todo.append(p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan())
            continue
        m = p.metrics().get("shuffleRecordsWritten")
        if kind == "ShuffleExchangeExec" and m.isDefined() and m.get().id() not in seen:
            seen.add(m.get().id())
            total += m.get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


@pytest.mark.parametrize("name", ["affected_closure", "composite_federation", "resolve_class_counts", "resolve_refs"])
def test_hot_names_are_not_paired_in_a_shuffle(spark, hot, name):
    df = QUERIES[name](spark, hot)
    columns, want = expected(hot, name)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == want
    assert 0 < shuffled(df) < 60 * PARTS


def test_slices_of_a_name_lose_and_repeat_nothing(spark, hot, monkeypatch):
    monkeypatch.setattr(resolve, "SLICE", 7)
    columns, want = expected(hot, "resolve_refs")
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES["resolve_refs"](spark, hot).collect()) == want


def test_pairs_are_dealt_out_evenly_and_take_little_space(spark, hot, tmp_path, monkeypatch):
    monkeypatch.setattr(resolve, "LINKS", 100, raising=False)
    QUERIES["resolve_refs"](spark, hot).write.parquet(out := str(tmp_path / "edges"))
    rows = [n for _, n in spark.read.parquet(out).groupBy("_metadata.file_path").count().collect()]
    size = sum(f.stat().st_size for f in (tmp_path / "edges").glob("part-*"))
    assert sum(rows) > 600_000 and max(rows) < 0.6 * sum(rows)
    assert size < 0.3 * sum(rows)
