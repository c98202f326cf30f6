import random

import pytest

import corpus_pipeline
from graphloft.llm import decontaminate, jaccard, quality, secrets
from tests.llm import test_operators as t

VOCABULARY = [a + b for a in ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru") for b in ("nd", "rk", "st", "ll", "mp", "sh", "rn")]
GOOD = [*range(30), 100, 101, 102, 105, 107]
PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("in"))
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(40, 90))), "en", f"s{i % 3}") for i in range(30)]
    text = lambda i: rows[i][1]
    own = lambda: " ".join(rng.choice(VOCABULARY) for _ in range(50))
    rows += [
        (100, text(3), "en", "s1"), (101, text(4) + " more", "en", "s2"), (102, own() + " token = abcdef0123456789", "en", None), (103, "short", "en", "s1"), (104, None, "en", "s1"),
        (105, own() + " " + PASSAGE.lower() + " " + own(), "en", "s0"), (106, " ".join(["one two three four five six"] * 10), "en", "s0"), (107, own() + " " + " ".join(PASSAGE.split()[:9]), "en", "s0"),
        (108, " ".join(f"%{i}#" for i in range(50)), "en", "s0"),
    ]
    rows.append(rows[2])
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in GOOD], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.dropDuplicates(["doc_id"]).collect()]
    score = t.brute_scores(texts, set(GOOD))
    base = {i: t.brute_base(x) for i, x in texts}
    good = {i for i, _ in texts if base[i][0] >= 10 and 100 * base[i][4] <= 20 * base[i][0] and score[i] >= quality.THRESHOLD}
    assert good == set(GOOD) and base[108][0] >= 10 and base[108][4] == 0
    kept = quality.keep(spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good and kept.count() == len(good) + 1
    lead = {c for _, c in t.brute_components([(i, x) for i, x in texts if i in good]).values()}
    one = jaccard.deduped(spark, kept, folder)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(lead) and not lead & {100, 101} and {3, 4, 102, 105, 107} <= lead
    leaked = {i for i, _, hit, _ in t.brute_leaks([(i, x) for i, x in texts if i in lead], [(1, PASSAGE)]) if hit}
    clean = decontaminate.clean(spark, one, folder)
    assert leaked == {105} and {r["doc_id"] for r in clean.collect()} == lead - leaked
    texts = {r["doc_id"]: r["text"] for r in secrets.masked(spark, clean, folder).collect()}
    assert "[SECRET]" in texts[102] and "abcdef0123456789" not in texts[102] and sum("[SECRET]" in x for x in texts.values()) == 1
    result = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in result} == lead - leaked and len(result) == len(lead - leaked)
    size = {}
    for r in result:
        assert r["size"] == len(t.WORD.findall(texts[r["doc_id"]])) and r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    goal = t.brute_targets(size)
    assert all(r["target"] == pytest.approx(goal[r["source"]]) for r in result)


@pytest.mark.parametrize("i", range(5))
def test_stages_take_empty_tables_and_odd_rows(spark, folder, docs, empty, i):
    name, stage = corpus_pipeline.STAGES[i]
    assert stage(spark, empty, folder).isEmpty()
    out = stage(spark, docs, folder)
    assert out.count() <= 11
    if i < 4:
        assert out.columns == docs.columns


def test_stages_take_any_column_names(spark, folder):
    names = ["doc_id", "text", "source", "_d", "_t", "d", "t", "_id", "_twice", "_lines", "_h", "_assign", "base", "ws", "c0", "marks", "n_words", "size", "root"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.selectExpr("*", *[f"'z' AS `{c}`" for c in names[3:]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert not out.isEmpty() and (out.columns == names or name == corpus_pipeline.STAGES[-1][0])
