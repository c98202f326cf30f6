"""Links, scripts and ids of HTML pages, by JVM-side patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _all(pattern: str):
    return F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of anchors, in order."""
    return pages.select("page_id", F.posexplode(_all(r'<a\s[^>]*?href="([^"]*)"')).alias("pos", "href"))


def page_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, scripts, sources): script elements, and those with a source."""
    return pages.select("page_id", F.size(_all(r"(<script)")).cast("long").alias("scripts"), F.size(_all(r'<script[^>]*\ssrc="([^"]*)"')).cast("long").alias("sources"))


def page_classes(pages: DataFrame) -> DataFrame:
    """(page_id, symbol): element classes as written, each once."""
    return pages.select("page_id", F.explode(F.array_distinct(_all(r'\sclass="([^"]+)"'))).alias("symbol"))


def page_ids(pages: DataFrame) -> DataFrame:
    """(page_id, symbol): element ids, each once."""
    return pages.select("page_id", F.explode(F.array_distinct(_all(r'\sid="([^"]+)"'))).alias("symbol"))
