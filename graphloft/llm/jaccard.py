"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

A text's set holds its distinct five-word shingles (64-bit hashes). Two sets link when
their Jaccard similarity reaches ``SIMILAR``; sets of a and b elements then differ in at
most ``k = a + b - 2 * ceil(SIMILAR / (1 + SIMILAR) * (a + b))`` elements.

Sizes fall into bands whose ends grow by ``1 / SIMILAR``. For each band the feature
domain is hashed into ``n1 > k / 2`` partitions, and each of these into ``SUB`` parts.
Two differing elements are needed to spoil a partition twice, so at least ``n1 - k // 2``
partitions of two similar sets differ in one element at most, and there the sets agree on
``SUB - 1`` of the parts. A set signs, in each partition, with the content of every subset
of ``SUB - 1`` parts, for its own band and for the band below (partners lie in one of
these).

Two guards keep this exact and even:

* subsets that are empty in both sets agree without a signature. A set is *regular* if
  fewer than ``n1 - k // 2`` of its partitions have an empty subset; a pair with a regular
  member shares a signature. An irregular set also signs with each element of its prefix
  (its first ``n - ceil(SIMILAR * n) + 1`` elements in one global order), so that two of
  them meet.
* shingles that occur very often are left out of the partitions, by one list that all
  sets use (so differences only shrink). Texts that share no more than a boilerplate
  passage have no signature in common then. The list is only a choice of features: which
  ones it holds changes cost, never results.

Before that, most sets without a partner leave: of the least elements of a set, as many as
`probe` says, a partner has some; elements that one class has alone count against it.

A set whose shared signatures are fewer than a partner would share (``n1 - k // 2`` less
its partitions with an empty subset) has no partner, and leaves before anything is compared.

Equal sets are one class. Classes that share a signature are compared with one pivot of
their bucket instead of with each other; links merge components, and what is left are
members of buckets with several components. After ``ROUNDS`` such rounds an element that
only one of the remaining classes has cannot lie in an intersection: a class's *support*
is what others have too, an overlap is no larger than either support, and classes whose
support is too small for any partner leave, which shrinks others. Buckets of up to
``WIDE`` members make pairs of the classes whose sizes and supports admit a link, so pairs
are at most ``WIDE / 2`` times a bucket's rows; members of larger buckets are compared in
blocks, as products of incidence matrices that return merged components only. No pair
that could link is dropped.

Defined cases: null and blank texts have an empty set and are linked with nothing; fewer
words than a shingle make one shingle of all; repeated rows share a class; a null doc_id
counts only where its class has no other id; extra columns stay out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloft.llm import bytesvec as B
from graphloft.llm.common import drop, parts, stage, table, tidy
from graphloft.shipping import ship

#: Words of a shingle; similarity as a ratio of whole numbers.
WORDS, NUMER, DENOM = 5, 75, 100
#: Parts of a partition; partitions over the least number, as a share of k.
SUB, SLACK = 3, 0.05
#: Frequent shingles that the partitions leave out, at most, and how frequent they are.
COMMON, COMMON_SHARE, COMMON_LEAST = 100_000, 0.002, 24
#: Rounds with one pivot per bucket; rounds that take classes of small support away.
ROUNDS, PEELS = 2, 2
#: A set must share one in PROBE of its elements among its least ones, at least, to sign.
PROBE = 10
#: Members of a bucket up to which its pairs are rows; sets and elements of a block of a larger one.
WIDE, BLOCK, ELEMENTS = 64, 512, 1 << 20


def bands(top: int) -> list[int]:
    """Largest size of each band, up to one that holds `top`."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * DENOM // NUMER))
    return out


def differ(a: int, b: int) -> int:
    """Elements in which similar sets of a and b elements may differ."""
    return a + b - 2 * -(-NUMER * (a + b) // (NUMER + DENOM))


def partitions(low: int, high: int) -> tuple[int, int]:
    """(k, n1) of the instance for a smaller set of up to `low` and a larger of up to `high` elements."""
    if low < 64:
        k = max(differ(a, b) for a in range(1, low + 1) for b in range(a, min(high, a * DENOM // NUMER) + 1))
    else:
        k = differ(low, high) + 1
    return k, k // 2 + 1 + math.ceil(SLACK * k)


def probe(n):
    """(p, l) of a set of n elements: of its p least, a similar set has at least l; numbers or columns.

    They share ``SIMILAR * n`` elements or more, so any ``n`` less that many, and ``l``, hold ``l`` of these.
    """
    if isinstance(n, int):
        least = max(1, n // PROBE)
        return n - -(-NUMER * n // DENOM) + least, least
    least = F.greatest(F.lit(1), F.floor(n / PROBE)).cast("long")
    return n - F.ceil(n * NUMER / DENOM).cast("long") + least, least


def _signatures(s: np.ndarray, common: np.ndarray, ends: list[int]) -> list[tuple[np.ndarray, int, int]]:
    """(signatures, instance, need): a partner in that instance shares `need` of the set's signatures there."""
    n = len(s)
    band = int(np.searchsorted(ends, n))
    often = np.isin(s, common, assume_unique=True) if len(common) else np.zeros(n, bool)
    own, out, regular = s[~often], [], True
    for i in (band, band - 1):
        if i < 0:
            continue
        k, n1 = partitions(ends[i], ends[i + 1] if i + 1 < len(ends) else ends[i] * DENOM // NUMER)
        if k == 0:
            continue  # only equal sets, and these are one class
        h = B.mix(own ^ np.uint64(i + 1))
        cell = ((h >> np.uint64(20)) % np.uint64(n1 * SUB)).astype(np.int64)
        content = np.zeros(n1 * SUB, np.uint64)
        np.add.at(content, cell, B.mix(h * np.uint64(0xFF51AFD7ED558CCD)))
        has = np.bincount(cell, minlength=n1 * SUB).reshape(n1, SUB) > 0
        content = content.reshape(n1, SUB)
        # a subset of SUB - 1 parts is known by the part that it leaves out
        content = content * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, SUB + 1, dtype=np.uint64)
        content = B.mix(content)
        whole = content.sum(1, keepdims=True, dtype=np.uint64) - content
        whole += (np.arange(n1 * SUB, dtype=np.uint64).reshape(n1, SUB) + np.uint64(i + 1) * np.uint64(1 << 40)) * np.uint64(0xC2B2AE3D27D4EB4F)
        filled = has.sum(1, keepdims=True) - has > 0
        sure = n1 - k // 2 - int(n1 - filled.all(1).sum())  # partitions that agree, less those that may agree without a signature
        regular &= sure > 0
        out.append((B.mix(whole[filled]), i, max(1, sure)))
    if not regular:
        prefix = n - -(-NUMER * n // DENOM) + 1
        first = np.concatenate([own[np.argsort(B.mix(own))], s[often][np.argsort(B.mix(s[often]))]])[:prefix]
        out.append((B.mix(first ^ np.uint64(0x5851F42D4C957F2D)), -1, 1))
    return out


def _sets(batches) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for lo, _, data, off in B.blocks(texts):
            for j, s in enumerate(B.shingle_hashes(*B.word_hashes(data, off), WORDS)):
                yield batch, lo + j, s


def _mark(s: np.ndarray) -> int:
    """The class of a set: a hash that does not depend on order."""
    return int(np.add.reduce(B.mix(s + np.uint64(len(s)))).astype(np.int64)) if len(s) else 0


def facts(docs: DataFrame) -> DataFrame:
    """(kind, doc_id, tag, n, mark, first): kind 0 a row's size and class, tag its text's hash; kind 1 a frequent shingle (mark) and its count (n).

    first holds the least ``probe(n)`` elements, once for the equal sets of a task.
    """
    names, kinds = ["kind", "doc_id", "tag", "n", "mark", "first"], (pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()))

    def work(batches):
        ids, tags, ns, marks, firsts, met = [], [], [], [], [], set()
        pool, rows, seen = [], 0, 0
        out = []

        def often():
            nonlocal pool, rows, seen
            if pool:
                h, c = np.unique(np.concatenate(pool), return_counts=True)
                keep = c >= max(COMMON_LEAST, COMMON_SHARE * rows)
                none = pa.nulls(int(keep.sum()), pa.int64())
                out.append(pa.RecordBatch.from_arrays([pa.array(np.ones(keep.sum(), np.int32)), none, none, pa.array(c[keep].astype(np.int64)), pa.array(h[keep].astype(np.int64)), pa.nulls(int(keep.sum()), pa.list_(pa.int64()))], names))
            pool, rows, seen = [], 0, 0

        def flush():
            nonlocal ids, tags, ns, marks, firsts
            if ids:
                out.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([0] * len(ids), ids, tags, ns, marks, firsts), kinds)], names))
            ids, tags, ns, marks, firsts = [], [], [], [], []

        last, col, tag = None, None, None
        for batch, j, s in _sets(batches):
            if batch is not last:
                last, col, tag = batch, batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("tag")).to_pylist()
            ids.append(col[j])
            tags.append(tag[j])
            ns.append(len(s))
            marks.append(m := _mark(s))
            new = len(s) and m not in met
            firsts.append(s[: probe(len(s))[0]].view(np.int64) if new else None)
            if len(met) > 500_000:
                met.clear()
            met.add(m)
            pool.append(s)
            rows, seen = rows + 1, seen + len(s)
            if seen > 1 << 21:
                often()
            if len(ids) >= 5_000:
                flush()
            while out:
                yield out.pop()
        often()
        flush()
        yield from out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag")).mapInArrow(work, "kind int, doc_id long, tag long, n long, mark long, first array<long>")


def signatures(sets: DataFrame, common: np.ndarray, top: int) -> DataFrame:
    """(sig, mark, need) of each set (mark, els). need also holds the instance."""
    ends = bands(top)
    sent = sets.sparkSession.sparkContext.broadcast(common)  # COMMON values at most

    def work(batches):
        common, sigs, marks, needs, n = sent.value, [], [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(marks)), pa.array(np.concatenate(needs))], ["sig", "mark", "need"])
        for batch in batches:
            own, els = batch.column(0).to_numpy(), batch.column(1)
            flat, at = els.values.to_numpy().view(np.uint64), els.offsets.to_numpy()
            for j, m in enumerate(own):
                for g, instance, need in _signatures(flat[at[j] : at[j + 1]], common, ends):
                    sigs.append(g)
                    marks.append(np.full(len(g), m, np.int64))
                    needs.append(np.full(len(g), (instance + 1) << 40 | need, np.int64))
                    n += len(g)
                if n > 200_000:
                    yield pack()
                    sigs, marks, needs, n = [], [], [], 0
        if n:
            yield pack()

    return sets.select("mark", "els").mapInArrow(work, "sig long, mark long, need long")


def _shared(rows: DataFrame) -> DataFrame:
    """Signatures that several classes have."""
    group = Window.partitionBy("sig")
    return rows.withColumns({"lo": F.min("mark").over(group), "hi": F.max("mark").over(group)}).filter("lo < hi").drop("lo", "hi")


def candidates(sigs: DataFrame, spark: SparkSession) -> DataFrame:
    """(sig, mark): shared signatures of classes that share as many as a partner must.

    A set has fewer shared signatures in an instance than a similar one would share with it:
    then it has no partner there, and its signatures go. That takes signatures from others,
    so it is done again while it helps.
    """
    left, had = None, 0
    for t in range(4):
        rows = _shared(sigs if left is None else left)
        if t == 0:  # a class that several tasks signed for counts once
            rows = rows.repartition("mark").distinct()
        enough = F.count(F.lit(1)).over(Window.partitionBy("mark", "need")) >= F.col("need").bitwiseAND((1 << 40) - 1)
        new = stage(rows.withColumn("_ok", enough).filter("_ok").drop("_ok"), "jac-sig")
        if left is not None:
            drop(left)
        left, n = new, new.count()
        if t and n > 0.9 * had:
            break
        had = n
    out = _shared(left).select("sig", "mark").distinct()
    out._graphloft_path = left._graphloft_path
    return out


def _one_of_equal(rows: DataFrame) -> DataFrame:
    """(sig, mark, w): of buckets with the same members one stays, with the number of such buckets."""
    group = Window.partitionBy("sig")
    a = rows.withColumns({"h": F.sum(F.xxhash64("mark") % (1 << 40)).over(group), "n": F.count(F.lit(1)).over(group), "lo": F.min("mark").over(group)})
    same = Window.partitionBy("lo", "h", "n")
    # each member of the bucket is in one group with its equals: the group's least signature stays
    b = a.withColumn("first", F.min("sig").over(same)).withColumn("w", F.count(F.lit(1)).over(same) / F.col("n"))
    return b.filter("sig = first").select("sig", "mark", "w")


def contents(docs: DataFrame) -> DataFrame:
    """(mark, n, els): the sets of those rows of docs (text, mark) whose set is the one that mark names."""

    def work(batches):
        marks, ns, els, size = [], [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(ns, pa.int64()), pa.array(els, pa.list_(pa.int64()))], ["mark", "n", "els"])
        for batch, j, s in _sets(batches):
            m = _mark(s)
            if m != batch.column(batch.schema.get_field_index("mark"))[j].as_py():
                continue  # another row with the same id
            marks.append(m)
            ns.append(len(s))
            els.append(s.view(np.int64))
            size += len(s)
            if size > 250_000:
                yield pack()
                marks, ns, els, size = [], [], [], 0
        if marks:
            yield pack()

    return docs.select("text", "mark").mapInArrow(work, "mark long, n long, els array<long>")


def components(links: DataFrame) -> DataFrame:
    """(v, root): the least vertex that links (a, b) lead to; only vertices with links."""
    edges = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "jac-edge")
    label = stage(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "jac-cc")
    while True:
        near = edges.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        best = label.join(near, "v", "left").select("v", "root", F.least("root", F.coalesce("near", "root")).alias("best"))
        over = label.select(F.col("v").alias("best"), F.col("root").alias("jump"))
        new = stage(best.join(over, "best", "left").select("v", F.least("best", F.coalesce("jump", "best")).alias("root"), (F.least("best", F.coalesce("jump", "best")) < F.col("root")).alias("moved")), "jac-cc")
        drop(label)
        label = new.select("v", "root")
        label._graphloft_path = new._graphloft_path
        if new.filter("moved").isEmpty():
            drop(edges)
            return label


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: whether their sets are similar enough.

    `sets` is bucketed by mark, so only pairs move, and once more with one set each. The
    pivot's set is joined first: what is shuffled next is dealt by the other member.
    """
    one = sets.select(F.col("mark").alias("a"), F.col("n").alias("na"), F.col("els").alias("ea"))
    two = sets.select(F.col("mark").alias("b"), F.col("n").alias("nb"), F.col("els").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    like = (F.least("na", "nb") * DENOM >= F.greatest("na", "nb") * NUMER) & (both * DENOM >= NUMER * (F.col("na") + F.col("nb") - both))
    return pairs.join(one, "a").join(two, "b").select("a", "b", like.alias("linked"))


def links(docs: DataFrame, known: DataFrame, spark: SparkSession) -> DataFrame | None:
    """(v, root) of the classes of `known` (kind, doc_id, tag, n, mark) that have links."""
    rows = known.filter("kind = 0 AND n > 0")
    top = rows.agg(F.max("n")).first()[0]
    if not top:
        return None
    common = np.sort(np.array([r["mark"] for r in known.filter("kind = 1").groupBy("mark").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "mark").limit(COMMON).collect()], np.int64).view(np.uint64))
    each = known.filter("first IS NOT NULL").select("mark", F.explode("first").alias("x"))
    alone = each.groupBy("x").agg(F.min("mark").alias("mark"), F.max("mark").alias("hi")).filter("mark = hi").groupBy("mark").agg(F.count(F.lit(1)).alias("alone"))
    p, least = probe(F.col("n"))
    own = rows.groupBy("mark").agg(F.first("n").alias("n"), F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("id"))
    chosen = own.join(alone, "mark", "left").filter(p - F.coalesce("alone", F.lit(0)) >= least).select("mark", "id")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), "text")
    name = f"jaccard_sets_{uuid.uuid4().hex[:12]}"
    n = parts(spark)
    try:
        with tidy(spark):
            contents(texts.join(chosen, "id").select("text", "mark")).repartition(n, "mark").write.bucketBy(n, "mark").format("parquet").saveAsTable(name)
        sets = spark.table(name)
        met = candidates(signatures(sets, common, top), spark)
        bucket = stage(_one_of_equal(met), "jac-bucket")
        drop(met)
        return _linked(bucket, sets)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _mixed(rows: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    group = Window.partitionBy("sig")
    return rows.withColumns({"lo": F.min("root").over(group), "hi": F.max("root").over(group)}).filter("lo < hi").drop("lo", "hi")


def _supported(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """open_ with each class's size n and support e, without classes that have too little of it.

    Elements are counted with a partial aggregate in each task, so one that a third of the
    classes share costs no more than others.
    """
    for _ in range(PEELS):
        own = sets.join(open_.select("mark").distinct(), "mark", "left_semi")
        alone = own.select("mark", F.explode("els").alias("x")).groupBy("x").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("c")).filter("c = 1")
        less = alone.groupBy("mark").agg(F.count(F.lit(1)).alias("less"))
        e = own.select("mark", "n").join(less, "mark", "left").select("mark", "n", (F.col("n") - F.coalesce("less", F.lit(0))).alias("e"))
        rows = open_.select("sig", "mark", "root").join(e.filter(f"e * {DENOM} >= n * {NUMER}").distinct(), "mark")
        new = stage(_mixed(rows), "jac-open")
        drop(open_)
        open_ = new
    return open_


def _narrow(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of a bucket of WIDE members at most whose sizes and supports admit a link."""
    one = rows.select("sig", F.col("mark").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("e").alias("ea"))
    two = rows.select(F.col("sig").alias("s"), F.col("mark").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("e").alias("eb"))
    may = (F.least("na", "nb") * DENOM >= F.greatest("na", "nb") * NUMER) & (F.least("ea", "eb") * (NUMER + DENOM) >= NUMER * (F.col("na") + F.col("nb")))
    return one.join(two, (F.col("sig") == F.col("s")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & may).select("a", "b").distinct()


def _tile(table: pa.Table) -> pa.Table:
    """(a, b) of a tile's components that links join: each with the least one it leads to."""
    mark_of, root_of = np.unique(table.column("root").to_numpy(), return_inverse=True)
    n, els = table.column("n").to_numpy(), table.column("els").combine_chunks()
    flat, size = els.flatten().to_numpy(), np.diff(els.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), size)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    kept = often[code] > 1
    code, row = (np.cumsum(often > 1) - 1)[code[kept]], row[kept]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    both, step = np.zeros((len(n), len(n)), np.float32), 2048
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, (lo, lo + step))
        part = np.zeros((len(n), step), np.float32)
        part[row[a:b], code[a:b] - lo] = 1
        both += part @ part.T
    linked = DENOM * both.astype(np.float64) >= NUMER * (n[:, None] + n[None, :] - both)
    least = np.arange(len(mark_of))
    x, y = np.nonzero(np.triu(linked, 1))
    x, y = root_of[x], root_of[y]
    while len(x) and (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]
    moved = np.flatnonzero(least != np.arange(len(least)))
    return pa.table({"a": pa.array(mark_of[least[moved]], pa.int64()), "b": pa.array(mark_of[moved], pa.int64())})


def _wide(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components that members of larger buckets link, compared in tiles of two blocks.

    A block has about BLOCK sets and ELEMENTS elements at most; a pair is no row, and a
    tile returns one row for each component that another one takes in.
    """
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / ELEMENTS)).cast("int")
    dealt = rows.withColumn("nb", blocks).withColumn("i", F.pmod(F.xxhash64("mark"), F.col("nb")).cast("int"))
    tiles = dealt.select("sig", "mark", "root", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    tiles = tiles.select("sig", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), "mark", "root")
    return tiles.join(sets, "mark").groupBy("sig", "i", "j").applyInArrow(_tile, "a long, b long")


def _linked(bucket: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(v, root) from the buckets (sig, mark, w) of candidates and their sets."""
    group = Window.partitionBy("sig")
    label, found, tried = None, None, None
    open_ = bucket.withColumn("root", F.col("mark"))
    for t in range(ROUNDS):  # one pivot for each bucket, another one in each round
        # even rounds: the member that meets most others (an original among its copies); odd ones: any
        met = open_.withColumn("n", F.count(F.lit(1)).over(group)).groupBy("mark").agg(F.sum(F.col("n") * F.col("w")).alias("met"))
        rank = -F.col("met") if t % 2 == 0 else F.xxhash64(F.lit(t), "mark").cast("double")
        pivot = F.min(F.struct(rank.alias("h"), "mark", "root")).over(group)
        p = open_.join(met, "mark").withColumn("p", pivot).filter("p.root <> root").select(F.col("p.mark").alias("a"), F.col("mark").alias("b"), "w")
        if t == 0:  # each member with the pivot that it meets most often
            p = p.groupBy("a", "b").agg(F.sum("w").alias("w")).groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a"))
        p = p.select("a", "b").distinct()
        if tried is not None:
            p = p.join(tried, ["a", "b"], "left_anti")
        seen = stage(_verified(p, sets), f"jac-pair{t}")
        both = seen.select("a", "b").union(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.union(both)
        label, found = _merged(label, found, seen)
        rooted = open_.select("sig", "mark", "w")
        if label is not None:
            rooted = rooted.join(label.withColumnRenamed("v", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        else:
            rooted = rooted.withColumn("root", F.col("mark"))
        new = stage(_mixed(rooted).select("sig", "mark", "w", "root"), "jac-open")
        drop(open_ if t else bucket)
        open_ = new
        if open_.isEmpty():
            return label
    open_ = _supported(open_, sets)
    if open_.isEmpty():
        return label
    sized = stage(open_.withColumns({"m": F.count(F.lit(1)).over(group), "size": F.sum("n").over(group)}), "jac-left")
    few = _narrow(sized.filter(F.col("m") <= WIDE)).join(tried, ["a", "b"], "left_anti")
    label, found = _merged(label, found, stage(_verified(few, sets), "jac-few"))
    wide = sized.filter(F.col("m") > WIDE)
    if not wide.isEmpty():
        label, found = _merged(label, found, stage(_wide(wide, sets).withColumn("linked", F.lit(True)), "jac-wide"))
    return label


def _merged(label: DataFrame | None, found: DataFrame | None, seen: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(components, all links) once the links of `seen` are there too."""
    new = seen.filter("linked").select("a", "b")
    if new.isEmpty():
        return label, found
    found = new if found is None else found.union(new)
    return components(found), found


def _rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n, mark, root) of each row: its class, and the class that names its component."""
    ship(docs.sparkSession)
    known = stage(facts(docs), "jac-fact")
    label = links(docs, known, docs.sparkSession)
    rows = known.filter("kind = 0").drop("kind")
    if label is None:
        return rows.withColumn("root", F.col("mark"))
    return rows.join(label.withColumnRenamed("v", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    rows = _rooted(docs)
    least = rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one document of each component, the one of smallest id.

    A row is known by its id and its text's hash: rows that share an id are judged by
    their own texts, a row without an id comes after all others, and of equal rows one
    stays. Texts without words are in no component and stay.
    """
    rows = _rooted(docs).withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    first = rows.filter("n > 0").groupBy("root").agg(F.min("at").alias("at"))
    keep = stage(first.select("at.doc_id", "at.tag").union(rows.filter("n = 0").select("doc_id", "tag").distinct()), "jac-keep")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    key, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own = own.withColumns({"k": key.cast("long"), "t": F.xxhash64(text)})
    kept = own.join(keep.toDF("k2", "t2"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left_semi")
    again = stage(own.groupBy("k", "t").count().filter("count > 1").select(F.col("k").alias("k2"), F.col("t").alias("t2")), "jac-again")
    if again.isEmpty():
        return kept.select(*names).toDF(*docs.columns)
    twice = F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2"))
    nth = F.row_number().over(Window.partitionBy("k", "t").orderBy(F.lit(0)))
    one = kept.join(again, twice, "left_semi").withColumn("nth", nth).filter("nth = 1")
    return kept.join(again, twice, "left_anti").select(*names).unionByName(one.select(*names)).toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, m.component_id
FROM g JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) m ON g.doc_id = m.v
"""
