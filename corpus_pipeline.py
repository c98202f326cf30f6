"""The corpus pipeline: documents pass these stages in order, each on what is left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents:
quality rules drop what they reject, the similarity join keeps one document of each group,
decontamination drops documents that hold benchmark windows, secrets are masked in place,
and the mix says how many words of each remaining document are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloft.llm import decontaminate, jaccard, mixing, quality, secrets
from graphloft.llm.common import stage, table

STAGES = [
    ("quality rules", quality.keep),
    ("n-gram Jaccard join", jaccard.deduped),
    ("benchmark decontamination", decontaminate.clean),
    ("secret scans", secrets.masked),
    ("mixing sources to target weights", mixing.mixed),
]

#: Hashed likelihood ratios and pivotal draws have no SQL form; tests hold brute force against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return docs
