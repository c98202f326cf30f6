"""Trace exports as span rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "STRUCT<stringValue: STRING, intValue: STRING>"
_ATTR = f"ARRAY<STRUCT<key: STRING, value: {_VALUE}>>"
SCHEMA = f"""resourceSpans ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTR}>, scopeSpans: ARRAY<STRUCT<spans: ARRAY<STRUCT<
  traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, startTimeUnixNano: STRING, endTimeUnixNano: STRING,
  attributes: {_ATTR}, status: STRUCT<code: STRING>>>>>>>"""


def attribute(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"] == key), 0)["value"]["stringValue"]


def status(code: Column) -> Column:
    """The status of a span by name or number."""
    c = F.upper(F.coalesce(code, F.lit("")))
    return F.when(c.isin("2", "STATUS_CODE_ERROR", "ERROR"), "Error").when(c.isin("1", "STATUS_CODE_OK", "OK"), "Ok").otherwise("Unset")


def spans(texts: DataFrame, column: str = "text") -> DataFrame:
    """Span rows of JSON texts; times are whole microseconds. A text that is no export raises an error."""
    doc = texts.select(F.from_json(column, SCHEMA).alias("d"), F.col(column).alias("_t"))
    r = F.coalesce(F.col("d.resourceSpans"), F.raise_error(F.concat(F.lit("no trace export: "), F.substring(F.coalesce("_t", F.lit("null")), 1, 80))).cast(f"ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTR}>, scopeSpans: ARRAY<STRUCT<spans: ARRAY<STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_ATTR}, status: STRUCT<code: STRING>>>>>>>"))
    a = doc.select(F.explode(r).alias("r")).select(attribute(F.col("r.resource.attributes"), "service.name").alias("service"), F.explode("r.scopeSpans").alias("s"))
    s = a.select("service", F.explode("s.spans").alias("s"))
    start, end = F.col("s.startTimeUnixNano").cast("long"), F.col("s.endTimeUnixNano").cast("long")
    return s.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"), "service", F.col("s.name").alias("name"),
        attribute(F.col("s.attributes"), "code.function").alias("code_function"), (start - start % 1000).cast("long").alias("_s"), F.greatest(end - start, F.lit(0)).alias("_d"), status(F.col("s.status.code")).alias("status"),
    ).withColumns({"start_us": F.expr("_s div 1000"), "duration_us": F.expr("_d div 1000")}).drop("_s", "_d")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Spans of the exports at a path, one document per file."""
    return spans(spark.read.text(path, wholetext=True), "value")
