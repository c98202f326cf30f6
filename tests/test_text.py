import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from graphloft.extract import scan
from graphloft.functions import porter, text
from graphloft.functions.languages import EXTENSIONS, language_of
from graphloft.operators import records, search
from graphloft.plans import router
from graphloft.plans.store import Reader, Store, StoreError, freshness
from graphloft.sources import files, otlp
from graphloft.streaming import debounce, watch


def names(p):
    return [(s[0], s[1], s[2], s[3]) for s in p.symbols]


PY = '''import os.path
class Base:
    def __init__(self):
        self.go()

    def go(self):
        helper(1)


class Child(Base):
    pass


def helper(x):
    return x
'''


def test_python():
    p = scan.parse("Python", PY)
    assert names(p) == [("Base", "class", 2, 7), ("Base::__init__", "method", 3, 4), ("Base::go", "method", 6, 7), ("Child", "class", 10, 11), ("helper", "function", 14, 15)]
    assert ("Child", "Base", "INHERITS") in p.structure and (scan.MODULE, "path", "IMPORTS") in p.structure
    assert ("Base::go", "helper", False) in p.calls and ("Base::__init__", "go", True) in p.calls


SOURCES = {
    "Rust": ("use std::fmt;\npub struct P { x: i32 }\nimpl P {\n    pub fn new() -> P { make(1) }\n}\nfn make(x: i32) -> P { P { x } }\n", [("P", "struct", 2, 2), ("P::new", "method", 4, 4), ("make", "function", 6, 6)]),
    "TypeScript": ("import { a } from './a';\nexport class K extends B {\n  run(x: number) {\n    return a(x);\n  }\n}\nexport function f() { return 1; }\n", [("K", "class", 2, 6), ("K::run", "method", 3, 5), ("f", "function", 7, 7)]),
    "Go": ('package m\nimport "fmt"\ntype S struct {\n\tx int\n}\nfunc (s *S) Get() int {\n\treturn s.x\n}\nfunc Make() S {\n\treturn S{}\n}\n', [("S", "struct", 3, 5), ("S::Get", "method", 6, 8), ("Make", "function", 9, 11)]),
    "Java": ("import a.b.C;\npublic class K extends B implements I {\n    public int run(int x) {\n        return go(x);\n    }\n}\n", [("K", "class", 2, 6), ("K::run", "method", 3, 5)]),
    "C": ("#include <stdio.h>\nstruct p { int x; };\nstatic int add(int a, int b) {\n    return plus(a, b);\n}\n", [("p", "struct", 2, 2), ("add", "function", 3, 5)]),
    "Cpp": ("namespace n {\nclass K : public B {\n    int run() { return 1; }\n};\n}\n", [("n::K", "class", 2, 4), ("n::K::run", "method", 3, 3)]),
    "CSharp": ("using System;\nnamespace N {\npublic class K : B {\n    public int Run(int x) {\n        return x;\n    }\n}\n}\n", [("N::K", "class", 3, 7), ("N::K::Run", "method", 4, 6)]),
    "Kotlin": ("import a.B\nclass K : Base() {\n    fun run(): Int {\n        return 1\n    }\n}\n", [("K", "class", 2, 6), ("K::run", "method", 3, 5)]),
    "Swift": ("import Foundation\nclass K: Base {\n    func run() -> Int {\n        return 1\n    }\n}\n", [("K", "class", 2, 6), ("K::run", "method", 3, 5)]),
    "Scala": ("import a.B\ntrait T {\n  def go(x: Int): Int = {\n    x\n  }\n}\n", [("T", "interface", 2, 6), ("T::go", "method", 3, 5)]),
    "Zig": ('const s = @import("std");\npub const P = struct {\n    x: i32,\n};\npub fn main() void {\n    go();\n}\n', [("P", "struct", 2, 4), ("main", "function", 5, 7)]),
    "Ruby": ("class K < B\n  def run\n    go(1)\n  end\nend\n", [("K", "class", 1, 5), ("K::run", "method", 2, 4)]),
    "Php": ("<?php\nrequire 'a.php';\nclass K extends B {\n    public function run() {\n        return 1;\n    }\n}\n", [("K", "class", 3, 7), ("K::run", "method", 4, 6)]),
    "Dart": ("import 'a.dart';\nclass K extends B {\n  int run() {\n    return 1;\n  }\n}\n", [("K", "class", 2, 6), ("K::run", "method", 3, 5)]),
    "Bash": ("go() {\n  echo hi\n}\ngo\n", [("go", "function", 1, 3)]),
    "PowerShell": ("function Get-It {\n  Write-Host 'x'\n}\n", [("Get-It", "function", 1, 3)]),
    "Lua": ("local function go(x)\n  return x\nend\n", [("go", "function", 1, 3)]),
    "Elixir": ("defmodule M do\n  alias A.B\n  def run(x) do\n    go(x)\n  end\nend\n", [("M", "class", 1, 6), ("M::run", "method", 3, 5)]),
    "R": ("library(x)\ngo <- function(a) {\n  a\n}\n", [("go", "function", 2, 4)]),
    "Sql": ("CREATE TABLE a (id INT);\nCREATE TABLE b (\n  a_id INT REFERENCES a(id)\n);\nCREATE VIEW v AS SELECT * FROM a;\n", [("a", "struct", 1, 1), ("b", "struct", 2, 4), ("v", "interface", 5, 5)]),
    "Css": ("@import 'x.css';\n.card {\n  color: var(--c);\n}\n#top { --c: red; }\n", [("card", "class", 2, 4), ("top", "struct", 5, 5), ("--c", "struct", 5, 5)]),
    "Html": ('<link href="a.css">\n<my-box id="top"></my-box>\n<script src="a.js"></script>\n', [("my-box", "class", 2, 2), ("top", "struct", 2, 2)]),
    "Json": ('{\n  "extends": "base",\n  "a": {"b": 1}\n}\n', [("extends", "struct", 2, 2), ("a", "struct", 3, 3), ("a::b", "struct", 3, 3)]),
    "Yaml": ("a:\n  b: 1\ndepends_on: [x, y]\n", [("a", "struct", 1, 1), ("a::b", "struct", 2, 2), ("depends_on", "struct", 3, 3)]),
    "Toml": ("[t]\nk = 1\n", [("t", "struct", 1, 1), ("t::k", "struct", 2, 2)]),
    "Properties": ("A=1\n# no\nB: 2\n", [("A", "struct", 1, 1), ("B", "struct", 3, 3)]),
    "Solidity": ("contract K is B {\n  function run() public {\n  }\n}\n", [("K", "class", 1, 4), ("K::run", "method", 2, 3)]),
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_languages(lang):
    source, expected = SOURCES[lang]
    assert names(scan.parse(lang, source)) == expected


def test_structure_of_languages():
    s = lambda lang: set(scan.parse(lang, SOURCES[lang][0]).structure)
    assert ("K", "B", "INHERITS") in s("Java") and ("K", "I", "IMPLEMENTS") in s("Java") and (scan.MODULE, "C", "IMPORTS") in s("Java")
    assert (scan.MODULE, "fmt", "IMPORTS") in s("Go") and (scan.MODULE, "stdio.h", "IMPORTS") in s("C")
    assert ("b", "a", "IMPORTS") in s("Sql") and ("v", "a", "IMPORTS") in s("Sql")
    assert ("depends_on", "x", "IMPORTS") in s("Yaml") and ("extends", "base", "IMPORTS") in s("Json")
    assert ("M", "A.B", "IMPORTS") in s("Elixir") and (scan.MODULE, "a.js", "IMPORTS") in s("Html")


def test_every_language_can_be_scanned():
    for lang in EXTENSIONS:
        scan.parse(lang, "x = 1\nfunction f() { g(1); }\n\"unclosed { \n")
    assert language_of("a/b.rs") == "Rust" and language_of(".env.local") == "Properties" and language_of("Makefile") is None


def test_routes():
    assert scan.routes("Python", "@app.get('/u')\ndef users():\n    pass\n") == [("GET /u", "users", 1)]
    assert scan.routes("Go", 'r.GET("/u", listUsers)\n') == [("GET /u", "listUsers", 1)]


def test_markdown():
    m = scan.markdown("---\ntags: [a, b]\n---\n# Top\nsee [[Note|x]] and `m.go()` #tag\n```\n[[no]]\n```\n## Sub\n")
    assert m["tags"] == ["a", "b", "tag"] and m["links"] == [("Top", "Note")] and m["code_refs"] == [("Top", "m.go()")]
    assert [h[0] for h in m["headings"]] == ["Top", "Sub"]


def test_index_of_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("from b import make\ndef run():\n    return make()\n")
    (tmp_path / "src/b.py").write_text("def make():\n    return gone()\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.py").write_text("def no(): pass\n")
    (tmp_path / ".hidden.py").write_text("def no(): pass\n")
    f = files.discover(spark, str(tmp_path))
    assert sorted(r["path"] for r in f.collect()) == ["src/a.py", "src/b.py"]
    g = files.build(files.extract(f))
    name = {r["id"]: r["symbol"] for r in g.nodes.collect()}
    assert sorted(name.values()) == ["make", "run"]
    assert [(name[r["src"]], name[r["dst"]], r["kind"], r["resolution_kind"]) for r in g.edges.collect()] == [("run", "make", "CALLS_EXACT", "UNIQUE_GLOBAL_EXACT")]
    assert "gone" in {r["short_name"] for r in g.unresolved_refs.collect()}

    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(StoreError):
        store.read()
    store.publish(g, "one")
    reader = Reader(store, 0)
    assert reader.view().nodes.count() == 2

    # an incremental run equals a full one
    (tmp_path / "src/b.py").write_text("def gone():\n    pass\ndef make():\n    return gone()\n")
    f2 = files.discover(spark, str(tmp_path))
    full = files.build(files.extract(f2))
    changed = spark.createDataFrame([("src/b.py",)], "path string")
    part = watch.reindex(store.read(), files.build(files.extract(f2.filter("path = 'src/b.py'"))), changed)
    flat = lambda g: sorted((a["symbol"], b["symbol"], e["kind"], e["resolution_kind"]) for n in [{r["id"]: r for r in g.nodes.collect()}] for e in g.edges.collect() for a, b in [(n[e["src"]], n[e["dst"]])])
    assert flat(part) == flat(full)
    store.publish(part, "two", base="one")
    assert reader.view().nodes.count() == 3
    with pytest.raises(StoreError):
        store.publish(part, "three", base="one")
    assert store.restore("one") and reader.view().nodes.count() == 2
    assert (freshness("a", "a"), freshness("a", "b"), freshness("a", "a", True), freshness(None, "a")) == ("Fresh", "Behind", "Dirty", "Unknown")


def test_porter():
    for a, b in (("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adoption", "adopt"), ("agreed", "agre"), ("sky", "sky")):
        assert porter.stem(a) == b


def test_text_functions(spark):
    d = spark.createDataFrame([("JwtTokenHandler",), ("parse_http-reply2Json",), ("HTTPServer",)], "s string")
    assert [r[0] for r in d.select(text.split_identifier(F.col("s"))).collect()] == ["Jwt Token Handler", "parse http reply2 Json", "HTTP Server"]
    assert text.expand_query("DB reader")[0][0] == "db" and text.expand_query("DB reader")[1] == ["reader"]
    assert text.fnv1a(b"") == text.FNV_START and text.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert abs((text.embed_text("a b a") ** 2).sum() - 1) < 1e-9 and not text.embed_text("").any()


def test_router():
    asked = {
        "Show me everybody who uses parse_header": ("callers", "parse_header"),
        "if `Ledger.post` changes, what breaks?": ("impact", "Ledger.post"),
        "blast radius for tax2024 please": ("impact", "tax2024"),
        "What does sendReminder call when a bill is late": ("callees", "sendReminder"),
        "callees of invoice": ("callees", "invoice_total"),
        "I wonder about zone_map": ("callers", "zone_map"),
    }
    table = ["invoice_total", "parse_header", "Ledger.post", "tax2024", "sendReminder", "zone_map", "tax2023"]
    for question, want in asked.items():
        assert router.route(question, table)[:2] == want
    assert router.route("path from a_1 to b_2", ["a_1", "b_2"]) == ("path", "a_1", "b_2")
    with pytest.raises(router.RouteError):
        router.route("who calls it", ["x"])


def test_rank_fusion(spark):
    lists = lambda *ls: spark.createDataFrame([(str(i), r, x) for i, one in enumerate(ls) for r, x in enumerate(one)], "list string, rank0 int, id long")
    got = lambda *ls: [r["id"] for r in search.rrf(lists(*ls), 4).orderBy("rank").collect()]
    assert got([3, 1, 2], [2, 3, 4]) == [3, 2, 1, 4] and got([2, 2], [1]) == [1, 2]


def test_masked_hit_does_not_starve_the_next(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, v array<float>")
    assert [r["id"] for r in search.vector_topk(v, [1.0, 0.0], 1, F.col("id") != 1).collect()] == [2]
    assert search.vector_topk(v.limit(0), [1.0, 0.0], 1).isEmpty()
    with pytest.raises(ValueError):
        search.vector_two_stage(v, [1.0], 1)


def test_lexical_search(spark):
    rows = spark.createDataFrame([(1, "parse the tokens"), (2, "login form"), (3, "nothing")], "id long, body string")
    p = search.postings(rows, ("body",))
    assert [r["id"] for r in search.bm25(p, rows, "parsing").collect()] == [1]
    assert sorted(r["id"] for r in search.find_all(p, rows, "auth").collect()) == [1, 2]


def test_spans(spark):
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [
        {"traceId": "t", "spanId": "1", "name": "h", "startTimeUnixNano": "1000000", "endTimeUnixNano": 4000999, "status": {"code": "STATUS_CODE_OK"}, "attributes": [{"key": "code.function", "value": {"stringValue": "f"}}]},
        {"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "s", "startTimeUnixNano": "0", "endTimeUnixNano": "8000000", "status": {"code": 2}}]}]}]}
    got = otlp.spans(spark.createDataFrame([(json.dumps(body),)], "text string")).orderBy("span_id").collect()
    assert [(r["service"], r["start_us"], r["duration_us"], r["status"], r["code_function"]) for r in got] == [("api", 1000, 3000, "Ok", "f"), ("api", 0, 8000, "Error", None)]
    for bad in ("{}", "not json"):
        with pytest.raises(Exception):
            otlp.spans(spark.createDataFrame([(bad,)], "text string")).collect()


def test_notes_at_the_edge_of_time(spark):
    n = spark.createDataFrame([(1, "ephemeral", 10), (2, "ephemeral", 11), (3, "crystallized", None)], "id long, tier string, expires_at long")
    assert sorted(r["id"] for r in records.recall(n, 10).collect()) == [2, 3]
    assert [r["id"] for r in records.expired(n, 10).collect()] == [1]


def test_rules_of_documents(spark):
    d = spark.createDataFrame([("a.md", "You must do it\n```\nx must not y\n```\nThey should never stop now\nmay")], "path string, text string")
    assert [r["line"] for r in records.adr_rules(d).orderBy("line").collect()] == [1, 5]


def test_debounce_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=s)) for s in (0, 1, 2, 30, 31, 500)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "path string, ts timestamp").write.json(src)
    seen = []
    s = spark.readStream.schema("path string, ts timestamp").json(src).withWatermark("ts", "0 seconds")
    b = debounce.batches(s, "ts", "5 seconds", "path", n=F.count(F.lit(1)))
    q = b.writeStream.outputMode("append").foreachBatch(lambda df, i: seen.extend(r["n"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = debounce.batches(spark.read.schema("path string, ts timestamp").json(src), "ts", "5 seconds", "path", n=F.count(F.lit(1)))
    assert sorted(seen) == [2, 3] and sorted(r["n"] for r in batch.collect()) == [1, 2, 3]
    assert (debounce.clamp(None), debounce.clamp(1), debounce.clamp(10**6)) == (2000, 100, 60_000)


def test_gated_apply(spark, graph, tmp_path):
    g = graph([(1, "a.rs"), (2, "b.rs"), (3, "c.rs")], [(1, 2), (2, 3)])
    done = []
    gate = watch.GatedApply(spark, str(tmp_path), lambda: g, lambda df: done.append(sorted(r["path"] for r in df.collect())), ceiling=3)
    batch = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    gate(batch("a.rs"))
    assert done == [] and [r["path"] for r in gate.waiting().collect()] == ["a.rs"]
    gate.ceiling = 4
    gate(batch("c.rs"))
    assert done == [["a.rs", "c.rs"]] and gate.waiting().isEmpty()
