"""WARC archives: writing them, and reading them back by boundary-chain verification.

Writing: a record is a block of header lines, an empty line, the payload, and an end of
two line breaks. Spark's text writer with that end as its line separator writes exactly
this, so archives are made, committed and retried like any other output. A file holds at
most so many records as ``RECORDS`` says for their size. Payloads of equal content (``REVISIT`` bytes or more) are stored
once: the record with the smallest page_id is the response, others revisit it.

Reading: a task emits, for each place in a file where the magic stands, the place that
record would end at if it were one (offset and successor). Magic inside a payload makes
such candidates too. Grouped by file, pointer jumping from the start keeps what is
reachable: in each round a reached offset also reaches what its pointer leads to, and every
pointer is replaced by its pointer's pointer, so n records take log2(n) rounds. Files whose
last reached successor is not their end are damaged, and reading says so.

Defined cases: a null payload is empty; a null page_id is written as an empty name and is
never smaller than another id; of rows with one id and one payload one is the response and
the others revisit it; a url's control characters are escaped; an empty table writes no
records and reads none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloft.llm.common import new_path, stage, table
from graphloft.shipping import ship

#: Fixed values of the format and of the contract.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT = 100
#: Records of one file, at most, for payloads up to so many bytes: a file fits in a task's memory.
RECORDS = ((1 << 16, 1000), (1 << 20, 64), (None, 4))
#: Date of records where none is given: the pages table has none, and reruns must agree.
DATE = "2000-01-01T00:00:00Z"
#: Repeated payloads up to which their table is sent to every task.
FEW = 200_000
_FIELDS = {b"WARC-Type": "record_type", b"WARC-Record-ID": "page_id", b"WARC-Refers-To": "refers_to", b"WARC-Payload-Digest": "payload_digest", b"X-Payload-Length": "payload_bytes"}
_HEAD = re.compile(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n")
_CANDIDATE = "file string, at long, next long, size long, record_type string, page_id string, refers_to string, payload_digest string, payload_bytes long, sound boolean, intact boolean, payload binary"


def rows(pages: DataFrame) -> tuple[DataFrame, bool]:
    """pages with digest, length, refers_to and again (it revisits); and whether rows share even id and payload.

    Only payloads that occur more than once make rows of the table that decides; up to
    ``FEW`` of them (counted) it is sent to every task and no payload is shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    a = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    a = a.withColumns({"payload_digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    long = a.filter(F.col("payload_bytes") >= REVISIT)
    least = long.groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id")).alias("first"), F.sum("n").alias("n"), F.max("n").alias("most"))
    least = stage(least.filter("n > 1").select(F.col("payload_digest").alias("_d"), F.col("first.page_id").alias("_first"), (F.col("most") > 1).alias("_twins")), "warc-least")
    few = F.broadcast(least) if least.count() <= FEW else least
    b = a.join(few, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") >= REVISIT), "left")
    again = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    b = b.withColumn("refers_to", F.when(again, F.col("_first"))).withColumn("again", again).drop("_d")
    return b, not least.filter("_twins").isEmpty()


def write(pages: DataFrame, path: str, records=RECORDS, date: str = DATE) -> None:
    """Writes pages as WARC files below path, all records with one date."""
    a, twins = rows(pages)
    b = a
    if twins:  # rows that share even their id are told apart by number; only they are sorted
        a = a.withColumn("_twin", F.coalesce(F.col("_twins"), F.lit(False)) & ~F.col("again"))
        nth = F.row_number().over(Window.partitionBy("payload_digest", "page_id").orderBy("url"))
        b = a.filter("_twin").withColumn("again", nth > 1).withColumn("refers_to", F.when(nth > 1, F.col("page_id"))).unionByName(a.filter("NOT _twin"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit("\r\n"))
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("again"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">")))).otherwise(""),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )
    low, largest = -1, pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for i, (high, count) in enumerate(records):
        if low < largest or low < 0:
            own = b.filter(F.col("payload_bytes") > low) if high is None else b.filter((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
            own.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", count).text(f"{path}/{i}")
        low = high or largest


def _parse(data: bytes, file: str, payload: bool = False) -> Iterator[tuple]:
    """Candidates of one file: every place of the magic, with the place that would follow.

    Responses are digested and measured; intact says that their header agrees.
    """
    at = data.find(MAGIC)
    while at >= 0:
        m = _HEAD.match(data, at)
        head = dict(x.split(b": ", 1) for x in m[1].split(b"\r\n") if b": " in x) if m else {}
        size = head.get(b"Content-Length", b"")
        if size.isdigit():
            stop = m.end() + int(size)
            sound = data[stop : stop + len(END)] == END.encode()
            got = {name: head[k].decode("utf-8", "replace") for k, name in _FIELDS.items() if k in head}
            length = got.get("payload_bytes", "")
            digest, n, body, intact = got.get("payload_digest"), int(length) if length.isdigit() else None, None, True
            if sound and got.get("record_type") == "response":
                body = data[m.end() : stop]
                said, digest, n = (digest, n), "sha256:" + hashlib.sha256(body).hexdigest(), len(body)
                intact = said == (digest, n)
            yield file, at, stop + len(END), len(data), got.get("record_type"), got.get("page_id"), got.get("refers_to"), digest, n, sound, intact, body if payload else None
        at = data.find(MAGIC, at + 1)


def candidates(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each place of the magic in the files below path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("size", pa.int64()), *[(k, pa.string()) for k in ("record_type", "page_id", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("sound", pa.bool_()), ("intact", pa.bool_()), ("payload", pa.binary())])

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = list(_parse(b.column(1)[i].as_py(), b.column(0)[i].as_py(), payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(work, _CANDIDATE)


def chain(at: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Which of the places `at` (sorted) the chain from 0 reaches, by pointer jumping over their successors."""
    n = len(at)
    place = np.minimum(np.searchsorted(at, follow), n - 1)
    jump = np.append(np.where(at[place] == follow, place, n), n)  # n: leads to no candidate
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and at[0] == 0
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            return reached[:n]
        reached, jump = more, jump[jump]


def reachable(cand: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start leads to.

    A file's candidates meet in one group; files, and so groups, are bounded by RECORDS.
    """

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        sound = group.filter(group["sound"])
        return sound.filter(pa.array(chain(sound["at"].to_numpy(), sound["next"].to_numpy())))

    return cand.groupBy("file").applyInArrow(work, _CANDIDATE)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records below path: (file, at, record_type, page_id, refers_to, payload_digest, payload_bytes, and payload if asked).

    Digest and length are those of the payload itself; revisits have them from the response they refer to.
    """
    good = stage(reachable(candidates(spark, path, payload)), "warc-good")
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0")
    broken = sizes.join(good.groupBy("file").agg(F.max("next").alias("end")), "file", "left").filter("end IS NULL OR end <> size").limit(1).collect()
    if broken:
        raise ValueError(f"no chain of records spans {broken[0]['file']}")
    altered = good.filter("NOT intact").limit(1).collect()
    if altered:
        raise ValueError(f"the payload at {altered[0]['at']} of {altered[0]['file']} is not what its header says")
    number = lambda c: F.expr(f"CAST(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1), '') AS BIGINT)")
    out = good.select("file", "at", "record_type", number("page_id").alias("page_id"), number("refers_to").alias("refers_to"), F.expr("substring(payload_digest, 8)").alias("payload_digest"), "payload_bytes", "payload")
    again, own = out.filter("record_type = 'revisit'"), out.filter("record_type = 'response'")
    asked = again.select(F.col("refers_to").alias("_r"), F.col("payload_digest").alias("_d")).distinct()
    here = lambda r: F.col(r).eqNullSafe(F.col("_r")) & (F.col("payload_digest") == F.col("_d"))
    first = own.join(asked, here("page_id")).groupBy("_r", "_d").agg(F.min("payload_bytes").alias("_n"), F.min("payload").alias("_p"))
    first = stage(first, "warc-first")
    few = F.broadcast(first) if not payload and first.count() <= FEW else first
    joined = again.join(few, here("refers_to"), "left")
    lost = joined.filter("_n IS NULL OR NOT (_n <=> payload_bytes)").limit(1).collect()
    if lost:
        raise ValueError(f"the revisit at {lost[0]['at']} of {lost[0]['file']} refers to no such response")
    whole = joined.withColumns({"payload_bytes": F.col("_n"), "payload": F.col("_p")}).select(*out.columns)
    out = out.filter("NOT (record_type <=> 'revisit')").unionByName(whole)
    return out if payload else out.drop("payload")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
