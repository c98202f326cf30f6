"""Debounced batches of events: closed by silence, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds of silence that close a batch: default, least and most.
DEFAULT_MS, LEAST_MS, MOST_MS = 2000, 100, 60_000


def clamp(ms: int | None) -> int:
    return DEFAULT_MS if ms is None else max(LEAST_MS, min(MOST_MS, ms))


def batches(events: DataFrame, ts: str, gap: str, *keys: str, **aggregates: Column) -> DataFrame:
    """(keys, start, end, aggregates): sessions of events less than a gap apart.

    For a stream, give `events` a watermark first; a batch is sent once its gap has passed.
    """
    s = events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)
