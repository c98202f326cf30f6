"""Suffix-array dedup: repeated byte strings, found by induced sorting in shards.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier in the corpus.

*Shards.* Each place's ``SPAN``-byte string is assigned to the least hash among its
``GRAM``-byte strings: equal strings get equal keys wherever they stand, so a key is a
shard of the corpus-wide suffix array and no comparison crosses shards. Neighbouring
places that share the key's occurrence form one stretch of text. Keys seen once end here;
of stretches with equal content all but the earliest are repeats as a whole (a passage that
a third of the documents share is one stretch from then on); only keys with different
contents, the edges of repeats, are sorted.

*Sorting.* A task lays the stretches of whole keys into a text and sorts its suffixes by
induction: the left-most S suffixes are named by their substrings and ranked, by doubling
over names; then L suffixes, and from these S suffixes, follow in one scan each. The scan's
priority queue is keyed by first byte, and within a byte entries arrive in order, so it is
a first-in-first-out queue for each byte. Queues hold suffix positions and move to disk
beyond ``HELD`` entries; scans take them in blocks. Common-prefix values of neighbours are
taken up to ``SPAN``, eight bytes at a time, and cut the order into groups of equal
strings, of which all but the earliest are repeats.

The order is exact to ``SPAN`` bytes; deeper ties are left as they fall.

Defined cases: a null text has no bytes and the digest of nothing; texts under ``SPAN``
bytes lose nothing; a null doc_id comes after all others; rows with one id are taken in
order of their texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloft.llm import bytesvec as B
from graphloft.llm.common import stage, table
from graphloft.shipping import ship

#: Fixed value: bytes of a string that counts as repeated.
SPAN = 100
GRAM = 32
#: Bytes of text that a task sorts at once, unless one key has more; queue entries held in memory.
SHARD, HELD = 3 << 20, 1 << 20
LAST = 2**63 - 1


def stretches(data: np.ndarray, off: np.ndarray):
    """(key, content, row, start, length) of each stretch of a block's rows."""
    n, w = len(data), SPAN - GRAM + 1
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n < SPAN:
        return empty
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(B._WEIGHT[data] * B._powers(B._BASE, n)[:n], out=total[1:])
    back = B._powers(B._INVERSE, n)
    h = B.mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    size = -(-len(h) // w) * w
    x = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = h
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    places = n - SPAN + 1
    least = np.minimum(behind[:places], ahead[w - 1 : w - 1 + places])
    row = np.searchsorted(off, np.arange(places), "right") - 1
    inside = np.arange(places) + SPAN <= off[row + 1]
    new = np.ones(places, bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: places - 1] == least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new & inside)
    if not len(at):
        return empty
    # a stretch ends before the next one, or where its row has no more places
    stop = np.minimum(np.append(at[1:], places), off[row[at] + 1] - SPAN + 1)
    length = stop - at + SPAN - 1
    content = B.mix((total[at + length] - total[at]) * back[at] + length.astype(np.uint64))
    return least[at], content, row[at], at - off[row[at]], length


class Queue:
    """First-in-first-out queues, one for each first byte, on disk beyond HELD entries."""

    def __init__(self, folder: str):
        self.folder, self.held, self.parts = folder, 0, [[] for _ in range(257)]

    def push(self, byte: int, places: np.ndarray) -> None:
        self.parts[byte].append(places)
        self.held += len(places)
        if self.held > HELD:
            for c, arrays in enumerate(self.parts):
                if arrays:
                    with open(os.path.join(self.folder, f"{id(self)}-{c}"), "ab") as f:
                        for a in arrays:
                            a.tofile(f)
                    self.parts[c] = []
            self.held = 0

    def pop(self, byte: int):
        """Entries of a byte in order, in blocks; those pushed meanwhile may wait for the next call."""
        path = os.path.join(self.folder, f"{id(self)}-{byte}")
        if os.path.exists(path):
            with open(path, "rb") as f:
                while len(block := np.fromfile(f, np.int64, 1 << 20)):
                    yield block
            os.remove(path)
        arrays, self.parts[byte] = self.parts[byte], []
        self.held -= sum(map(len, arrays))
        if arrays:
            yield np.concatenate(arrays)


def _ranks(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the left-most S suffixes, exact to SPAN bytes."""
    units = np.zeros(len(text) + 8, np.uint64)
    units[: len(text)] = text.astype(np.uint64) * np.uint64(2) + is_s
    quad = lambda i: (units[i] << np.uint64(48)) | (units[i + 1] << np.uint64(32)) | (units[i + 2] << np.uint64(16)) | units[i + 3]
    length = np.minimum(np.append(lms[1:], len(text) - 1) - lms + 1, SPAN + 4)
    order, group = np.arange(len(lms)), np.zeros(len(lms), np.int64)
    active, j = np.arange(len(lms)), 0  # places of `order` that still share a group
    while len(active):
        who = order[active]
        left = np.maximum(length[who] - j, 0)
        keep = np.where(left >= 4, np.uint64(0xFFFFFFFFFFFFFFFF), ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (16 * np.minimum(left, 3)).astype(np.uint64)))
        key = np.where(left > 0, quad(np.minimum(lms[who] + j, len(text))) & keep, np.uint64(0))
        s = np.lexsort((key, group[active]))
        order[active], key, g = who[s], key[s], group[active]
        cut = np.ones(len(active), bool)
        cut[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        # a group is known by the place of its first member
        group[active] = active[np.flatnonzero(cut)][np.cumsum(cut) - 1]
        j += 4
        same = np.zeros(len(active), bool)
        same[:-1] |= ~cut[1:]
        same[1:] |= ~cut[1:]
        active = active[same & (length[order[active]] > j)] if j < SPAN + 4 else active[:0]
        if len(active):  # members of one group stay together or leave together
            open_ = np.isin(group, np.unique(group[active]))
            active = np.flatnonzero(open_)
            if not (length[order[active]] > j).any():
                break
    rank = np.empty(len(lms), np.int64)
    rank[order] = group
    # Doubling over names: the recursion's order of the reduced string, as deep as SPAN bytes need.
    h = 1
    while 2 * h < SPAN + 2:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * np.int64(len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        cut = np.ones(len(k), bool)
        cut[1:] = k[1:] != k[:-1]
        if cut.all() and h > 1:
            rank[order] = np.arange(len(k))
            break
        rank[order] = np.flatnonzero(cut)[np.cumsum(cut) - 1]
        h *= 2
    return rank


def _scan(queue: Queue, done: Queue, text: np.ndarray, takes: np.ndarray, bytes_, extra) -> None:
    """One induction: bytes in order; of each, its queue until that is empty, then extra(byte).

    What a byte's entries add to their own queue stands behind all that is there already,
    on disk or in memory.
    """

    def lead(places) -> None:
        before = places[places > 0] - 1
        before = before[takes[before]]
        if not len(before):
            return
        c = text[before]
        order = np.argsort(c, kind="stable")
        c, before = c[order], before[order]
        edges = np.flatnonzero(np.diff(c, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(c)]):
            queue.push(int(c[a]), before[a:b])

    for byte in bytes_:
        more = True
        while more:
            more = False
            for block in queue.pop(byte):
                more = True
                done.push(byte, block)
                lead(block)
        for block in extra(byte):
            lead(block)


def suffix_order(text: np.ndarray, folder: str):
    """Yields the suffixes of text (values 0 to 256) in order, in blocks; exact to SPAN bytes."""
    n = len(text)
    text = text.astype(np.int16)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:] - text[:-1])
    step[-1] = -1  # the end is less than every byte
    where = np.where(step != 0, np.arange(n), n - 1)
    is_s = step[np.minimum.accumulate(where[::-1])[::-1]] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    ordered = lms[np.argsort(_ranks(text, is_s, lms), kind="stable")] if len(lms) else lms
    first = text[ordered]
    edge = np.searchsorted(first, np.arange(258))
    l_queue, l_done = Queue(folder), Queue(folder)
    l_queue.push(int(text[-1]), np.array([n - 1]))
    _scan(l_queue, l_done, text, ~is_s, range(257), lambda c: [ordered[edge[c] : edge[c + 1]]] if edge[c] < edge[c + 1] else [])
    s_queue, s_done, l_kept = Queue(folder), Queue(folder), Queue(folder)

    def l_back(c):
        blocks = list(l_done.pop(c))
        for b in blocks:
            l_kept.push(c, b)
        return [b[::-1] for b in reversed(blocks)]

    _scan(s_queue, s_done, text, is_s, range(256, -1, -1), l_back)
    for c in range(257):
        yield from l_kept.pop(c)
        yield from [b[::-1] for b in reversed(list(s_done.pop(c)))]


def repeats(strings: list[bytes], place: np.ndarray) -> np.ndarray:
    """(string, offset) of each SPAN-byte string that stands earlier; place: each string's order in the corpus."""
    size = np.array([len(s) for s in strings])
    start = np.cumsum(np.append(0, size[:-1] + 1))
    n = int(start[-1] + size[-1] + 1)
    text = np.zeros(n + 8 * 14, np.int16)
    for a, s in zip(start, strings):
        text[a : a + len(s)] = np.frombuffer(s, np.uint8)
        text[a : a + len(s)] += 1
    flat = np.zeros(n + 8 * 14, np.uint8)
    flat[:n] = np.maximum(text[:n] - 1, 0)
    word = np.ndarray(n + 8 * 13, np.uint64, flat, 0, (1,))
    own = np.repeat(np.arange(len(strings)), size + 1)
    left = np.repeat(start + size, size + 1) - np.arange(n)
    folder, out, kept = tempfile.mkdtemp(prefix="suffix-"), [], np.zeros(0, np.int64)

    def flush(places, last):
        """Cuts places (in suffix order) into groups; all of the last group waits for more."""
        same = np.zeros(len(places), bool)  # equal to the one before
        todo = np.arange(1, len(places))
        for j in range(0, SPAN - 8, 8):
            todo = todo[word[places[todo] + j] == word[places[todo - 1] + j]]
        todo = todo[word[places[todo] + SPAN - 8] == word[places[todo - 1] + SPAN - 8]]
        same[todo] = True
        head = np.flatnonzero(~same)
        stop = len(places) if last else head[-1]
        if stop:
            head = head[head < stop]
            s = own[places[:stop]]
            at = place[s] + (places[:stop] - start[s])
            first = np.repeat(np.minimum.reduceat(at, head), np.diff(np.append(head, stop)))
            out.append(places[:stop][at > first])
        return places[stop:]

    try:
        for block in suffix_order(text[:n], folder):
            block = block[left[block] >= SPAN]
            if len(block):
                kept = np.concatenate([kept, block])
                if len(kept) > 1 << 18:
                    kept = flush(kept, False)
        if len(kept):
            flush(kept, True)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    found = np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return np.stack([own[found], found - start[own[found]]], 1) if len(found) else np.zeros((0, 2), np.int64)


def _runs(row: np.ndarray, at: np.ndarray):
    """(row, start, end) of the bytes that strings at sorted places cover."""
    if not len(row):
        return row, at, at
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + SPAN)))
    end = np.append(cut[1:], len(at)) - 1
    return row[cut], at[cut], at[end] + SPAN


def spans(docs: DataFrame) -> DataFrame:
    """(d, nth, start, end) of repeated bytes, overlapping; docs: (d, nth, text)."""
    spark = docs.sparkSession
    ship(spark)

    def split(batches):
        for b in batches:
            d, nth = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, off in B.blocks(b.column(2)):
                key, content, row, start, length = stretches(data, off)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(d[lo + row]), pa.array(nth[lo + row].astype(np.int32)), pa.array(start), pa.array(length)], ["key", "content", "d", "nth", "start", "length"])

    parts = docs.mapInArrow(split, "key long, content long, d long, nth int, start long, length long")
    by_key, same = Window.partitionBy("key"), Window.partitionBy("key", "content").orderBy("d", "nth", "start")
    a = parts.withColumns({"n": F.count(F.lit(1)).over(by_key), "lo": F.min("content").over(by_key), "hi": F.max("content").over(by_key)}).filter("n > 1")
    a = a.withColumn("nr", F.row_number().over(same))
    a = stage(a.filter("nr > 1 OR lo < hi").select(F.when(F.col("nr") == 1, F.col("key")).alias("key"), "d", "nth", "start", "length"), "suf-part")
    whole = a.filter("key IS NULL").select("d", "nth", "start", (F.col("start") + F.col("length")).alias("end"))
    asked = a.filter("key IS NOT NULL").groupBy("d", "nth").agg(F.collect_list(F.struct("key", "start", "length")).alias("at"))

    def fetch(batches):
        for b in batches:
            d, nth, texts, at = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                t, want = texts[i].as_py() or b"", at[i].as_py()
                for j in range(0, len(want), 20_000):
                    w = want[j : j + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in w], pa.int64()), pa.array([d[i].as_py()] * len(w), pa.int64()), pa.array([nth[i].as_py()] * len(w), pa.int32()), pa.array([x["start"] for x in w], pa.int64()), pa.array([t[x["start"] : x["start"] + x["length"]] for x in w], pa.binary())], ["key", "d", "nth", "start", "body"])

    bodies = docs.join(asked, ["d", "nth"]).select("d", "nth", F.col("text").cast("binary").alias("text"), "at").mapInArrow(fetch, "key long, d long, nth int, start long, body binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = bodies.repartition(n, "key").sortWithinPartitions("key")

    def sort(batches):
        def one(rows):
            # the order of strings in the corpus: by document, then by place
            d, nth, start = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
            order = np.lexsort((start, nth, d))
            doc = np.zeros(len(rows), np.int64)
            doc[order[1:]] = np.cumsum((d[order[1:]] != d[order[:-1]]) | (nth[order[1:]] != nth[order[:-1]]))
            found = repeats([r[4] for r in rows], doc * (1 << 40) + start)
            s, lo, hi = _runs(found[:, 0], found[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(nth[s].astype(np.int32)), pa.array(start[s] + lo), pa.array(start[s] + hi)], ["d", "nth", "start", "end"])

        rows, size = [], 0
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if size > SHARD and rows[-1][0] != r[0]:
                    yield one(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield one(rows)

    inner = stage(sorted_.mapInArrow(sort, "d long, nth int, start long, end long"), "suf-inner")
    return whole.unionByName(inner)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, d, nth, text): d orders documents, nth tells rows of one id apart."""
    a = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), "text")
    if a.groupBy("d").count().filter("count > 1").isEmpty():
        return a.withColumn("nth", F.lit(0))
    return stage(a.withColumn("nth", F.row_number().over(Window.partitionBy("d").orderBy("text"))), "suf-docs")


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept if asked) of each row."""
    a = numbered(docs)
    ship(docs.sparkSession)
    found = spans(a.select("d", "nth", "text")).groupBy("d", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    found = stage(found, "suf-cut")

    def cut(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                t, at, out, gone, n = b.column(1)[i].as_py() or b"", 0, [], 0, 0
                edge = -1
                for x in b.column(2)[i].as_py() or ():
                    lo, hi = max(at, x["start"]), x["end"]
                    if x["start"] > edge:
                        n += 1
                    edge = max(edge, hi)
                    if hi > lo:
                        out.append(t[at:lo])
                        gone, at = gone + hi - lo, hi
                out.append(t[at:])
                kept = b"".join(out)
                rows.append((b.column(0)[i].as_py(), len(t), gone, n, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = a.join(found, ["d", "nth"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "cut")
    out = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM d WHERE length(h) >= 200),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM p),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE (w.doc_id, w.i) <> f.first),
b AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS new FROM c),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS e FROM r GROUP BY ALL),
k AS (
  SELECT d.doc_id, d.h, s.a, s.e, coalesce(lag(s.e) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) AS before,
         lead(s.a) OVER (PARTITION BY d.doc_id ORDER BY s.a) AS next
  FROM d LEFT JOIN s USING (doc_id))
SELECT doc_id, CAST(length(any_value(h)) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(e - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
       sha256(unhex(CASE WHEN count(a) = 0 THEN any_value(h) ELSE
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY a) END)) AS kept_sha256
FROM k GROUP BY doc_id
"""
