"""Models and archives over whole inputs: nothing is left out because there is much of the rest."""

import math
from pathlib import Path

import pytest

from graphloft.llm import language, quality, warc
from graphloft.llm.common import new_path


def test_every_language_is_learnt_from_all_its_documents(spark):
    n, rare = 12_000, [f"{a}{b}" for a in "qxyz" for b in "abcde"]
    rows = [(i, "the house", "en") for i in range(n)] + [(n + i, f"word{c * 3} the", c) for i, c in enumerate(rare)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(model) == sorted(["en", *rare])
    at = spark.range(1).select(language._buckets(language.F.lit("the house"))).first()[0]
    total = 2 * n + language.PRIOR * language.BUCKETS
    assert all(math.isclose(model["en"][b], math.log((n + language.PRIOR) / total)) for b in at)
    page = (1, "http://a.com/", f'<html lang="qa"><p>{"wordqaqaqa " * 5}</p></html>')
    got = language.identify(spark.createDataFrame([page], "page_id long, url string, html string"), model).first()
    assert (got["lang"], got["text_lang"], got["declared"]) == ("qa", "qa", "qa")


def test_quality_target_is_all_that_is_labelled_good(spark):
    n = 4500
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    for few in (quality.FEW, 0):  # the target equals the corpus
        assert max(map(abs, quality.fit(docs, labels, few))) < 1e-12


def test_warc_gives_payloads_back_and_sees_altered_ones(spark):
    data = [(1, "u", "a" * 200), (2, "u", "a" * 200), (3, "v", "short"), (4, "v", None)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), path)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path, payload=True).collect()}
    assert got == {i: t or "" for i, _, t in data}
    for f in Path(path).rglob("part-*"):
        f.write_bytes(f.read_bytes().replace(b"short", b"shirt"))
    for crc in Path(path).rglob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="header"):
        warc.read(spark, path)
