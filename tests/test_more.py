"""Sources, stores and streams under the conditions that break them."""

import pytest
from pyspark.sql import functions as F

from graphloft import storage
from graphloft.api import Engine
from graphloft.operators import traverse
from graphloft.plans import store as S
from graphloft.sources import files, ignore
from graphloft.streaming.watch import GatedApply


def test_discovery_honours_ignore_files(spark, tmp_path):
    tree = {
        ".gitignore": "*.gen.py\n/private/\n!keep.gen.py\ndocs/*.md\n", "a.py": "", "b.gen.py": "", "keep.gen.py": "", "private/x.py": "", "sub/private/x.py": "",
        "docs/n.md": "", "docs/deep/n.md": "", "sub/.gitignore": "c.py\n", "sub/c.py": "", "c.py": "", "vendor/v.py": "", "target/t.py": "", "env/pyvenv.cfg": "", "env/lib/e.py": "", "data.bin": "", ".hidden.py": "",
    }
    for name, text in tree.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text or "x = 1\n")
    got = {r["path"] for r in files.discover(spark, str(tmp_path)).collect()}
    assert got == {"a.py", "keep.gen.py", "sub/private/x.py", "docs/deep/n.md", "c.py", "vendor/v.py"}


@pytest.mark.parametrize(
    "text,path,out",
    [
        ("a", "x/a/y.py", True), ("/a", "x/a", False), ("a/", "a", False), ("a/", "a/b", True), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("*.py", "d/x.py", True),
        ("x?.py", "x1.py", True), ("x[0-3].py", "x4.py", False), ("x[!0-3].py", "x4.py", True), ("d/\n!d/a", "d/a", True), ("*.py\n!b.py", "b.py", False), ("\\!x", "!x", True), ("# c", "# c", False), ("a b ", "a b", True), ("**/q", "q", True),
    ],
)
def test_ignore_patterns(spark, text, path, out):
    frame = spark.createDataFrame([(path,)], "path string")
    assert frame.select(ignore.ignored(F.col("path"), ignore.rules("", text))).first()[0] == out


def test_a_publication_that_fails_changes_nothing(spark, graph, tmp_path, monkeypatch):
    s = S.Store(spark, str(tmp_path / "store"))
    s.publish(graph([1], []), sha="one")
    with monkeypatch.context() as m:
        m.setattr(S, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.publish(graph([1, 2], []), sha="two", keep=1)
    assert s.current()["sha"] == "one" and s.read().nodes.count() == 1
    s.publish(graph([1, 2, 3], []), sha="three", keep=1)
    assert s.current()["sha"] == "three" and s.read().nodes.count() == 3 and not s.restore("one")
    s.publish(graph([1], []), sha="four", keep=2)
    assert s.restore("three") and s.read().nodes.count() == 3


def test_a_batch_that_fails_is_not_lost(spark, graph, tmp_path):
    g = graph([(i, f"f{i}") for i in range(1, 6)], [(1, i) for i in range(2, 6)])
    done, fail = [], [True]

    def apply(changed):
        if fail[0]:
            raise RuntimeError("no")
        done.append({r["path"] for r in changed.collect()})

    gate = GatedApply(spark, str(tmp_path), lambda: g, apply, ceiling=3)
    batch = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    gate(batch("f1"))  # reaches too far, waits
    assert {r["path"] for r in gate.waiting().collect()} == {"f1"}
    gate.ceiling = 100
    with pytest.raises(RuntimeError):
        gate(batch("f2"))
    assert {r["path"] for r in gate.waiting().collect()} == {"f1"}
    fail[0] = False
    gate(batch("f2"))
    assert done == [{"f1", "f2"}] and gate.waiting().isEmpty()


def test_both_searches_take_the_least_edge(spark, graph):
    g = graph([1, 2, 3], [(1, 2, "B", "Z"), (1, 2, "A", "Y"), (1, 2, "A", "X"), (2, 3, "A", None), (2, 3, "A", "Q")])
    seed = spark.createDataFrame([(1,)], "id long")
    one, two = (sorted(traverse.search(g.edges, seed, local_edges=n).collect()) for n in (10, 0))
    assert one == two and [(r["id"], r["edge_kind"], r["resolution_kind"]) for r in one] == [(1, None, None), (2, "A", "X"), (3, "A", None)]


def test_questions_are_grounded_in_all_symbols(spark, graph):
    g = graph(list(range(1, 30)), [(1, 2), (3, 2)])
    assert {r["id"] for r in Engine(g).ask("who calls `m::s2`?").collect()} == {1, 3}


def test_names_of_a_folder(spark, tmp_path):
    assert storage.names(spark, str(tmp_path / "none")) == []


@pytest.mark.parametrize("front,reach", [(2_000, 100_000), (1, 100_000), (3, 4), (0, 0)])
def test_search_by_value_and_by_join_agree(spark, graph, monkeypatch, front, reach):
    import random

    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40), rng.choice("AB"), rng.choice("XY")) for _ in range(70)]
    g = graph(list(range(40)), pairs)
    monkeypatch.setattr(traverse, "SMALL_FRONT", front)
    monkeypatch.setattr(traverse, "SMALL_REACH", reach)
    seed = spark.createDataFrame([(pairs[0][0],), (pairs[1][0],)], "id long")
    for hops in (None, 0, 2):
        want = sorted(traverse.search(g.edges, seed, hops, local_edges=1000).collect())
        assert sorted(traverse.search(g.edges, seed, hops, local_edges=0).collect()) == want
