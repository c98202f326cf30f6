"""Mixing sources to target weights: pivotal dependent rounding in a reduction tree.

Every document of a source is wanted ``target / source_size`` times. The whole copies are
given outright; what is left is a probability, held as a mass of words between 0 and the
document's size. Two documents at a time, mass moves from one to the other until one of
them is empty or full; the direction is drawn so that both expectations stay as they
were. A source's total mass never changes in this, so that its words miss the target by
no more than the last document that is left undecided.

The work is a tree: documents of a source are dealt into groups of about ``FAN`` by hash,
each group is folded where it lies, and only its one undecided document goes on to the
next level. A source of any size therefore splits over all tasks, and each level shuffles
``1 / FAN`` of the rows of the one before.

Defined cases: a null or blank text has size 0 and takes 0; the null source comes last in
order and is a source like any other; repeated rows (equal ids) are separate documents,
numbered among themselves; draws depend on ids, numbers and sizes alone, so that reruns
agree; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloft.llm.common import stage, table, words

#: Fixed values of the mix: weights by source in code-point order, share of all sizes, most copies.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Documents that meet in one group of the tree.
FAN = 64
#: Sources up to which their table is sent to every task; beyond, it is joined by shuffle.
FEW_SOURCES = 20_000
SEED = 20_240_501

_ITEM = "struct<doc_id:bigint,nth:int,size:bigint,mass:double>"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, filled up to `most` times a source's size."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place, F.lit(len(weights))))
    a = by.withColumn("w", w).withColumn("roof", most * F.col("source_size")).withColumn("at", F.col("roof") / F.col("w"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("roof").over(before), F.lit(0.0))
    b = a.withColumn("rate", left / F.sum("w").over(after))
    # The first source that its roof does not stop gives the rate of all the rest.
    b = b.withColumn("rate", F.min(F.when(F.col("rate") <= F.col("at"), F.struct("at", "rate"))).over(every)["rate"])
    goal = F.least(F.col("roof"), F.coalesce(F.col("rate") * F.col("w"), F.col("roof")))
    return b.select("source", F.col("source_size").cast("long").alias("source_size"), "n_docs", goal.cast("double").alias("target"))


def _fold(level: int, last: bool) -> str:
    """SQL for one group: (cur, out), where `out` is decided and `cur` is not."""
    draw = lambda a, b: f"shiftrightunsigned(xxhash64({SEED}L, {level}, {a}.doc_id, {a}.nth, {b}.doc_id, {b}.nth), 11) * {2.0**-53!r}D"
    snap = lambda m, s: f"CASE WHEN {m} < 1e-7 THEN 0D WHEN {s} - {m} < 1e-7 THEN CAST({s} AS DOUBLE) ELSE {m} END"
    item = lambda v, m: f"named_struct('doc_id', {v}.doc_id, 'nth', {v}.nth, 'size', {v}.size, 'mass', {m})"
    whole = lambda v: f"({v}.mass = 0D OR {v}.mass = {v}.size)"
    moved = f"""transform(array(named_struct(
          'a_b', least(s.cur.mass, x.size - x.mass), 'b_a', least(x.mass, s.cur.size - s.cur.mass), 'u', {draw('s.cur', 'x')})),
        t -> CASE WHEN t.u * (t.a_b + t.b_a) < t.b_a THEN -t.a_b ELSE t.b_a END)[0]"""
    both = f"""transform(array({moved}), d -> named_struct(
          'a', {item('s.cur', snap('(s.cur.mass + d)', 's.cur.size'))}, 'b', {item('x', snap('(x.mass - d)', 'x.size'))}))[0]"""
    step = f"""transform(array({both}), p -> named_struct(
          'cur', CASE WHEN NOT {whole('p.a')} THEN p.a WHEN NOT {whole('p.b')} THEN p.b END,
          'out', concat(s.out, filter(array(p.a, p.b), y -> {whole('y')}))))[0]"""
    end = "s"
    if last:  # the root: what is left is drawn alone
        u = draw("s.cur", "s.cur")
        end = f"""named_struct('cur', CAST(NULL AS {_ITEM}), 'out', CASE WHEN s.cur IS NULL THEN s.out ELSE concat(s.out, array(
          {item('s.cur', f'CASE WHEN {u} * s.cur.size < s.cur.mass THEN CAST(s.cur.size AS DOUBLE) ELSE 0D END')})) END)"""
    return f"""aggregate(xs, named_struct('cur', CAST(NULL AS {_ITEM}), 'out', CAST(array() AS array<{_ITEM}>)),
      (s, x) -> CASE WHEN s.cur IS NULL THEN named_struct('cur', CAST(x AS {_ITEM}), 'out', s.out) ELSE {step} END, s -> {end})"""


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs."""
    sizes = stage(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix-size")
    twin = Window.partitionBy("doc_id", "size", "source").orderBy(F.lit(0))
    goals = targets(sizes, weights, share, most)
    goals = stage(goals, "mix-goal")
    n, largest = goals.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    few = F.broadcast(goals) if n <= FEW_SOURCES else goals  # counted just now
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.withColumn("nth", F.row_number().over(twin)).alias("d").join(few.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("doc_id", "nth", "d.source", "size", "source_size", "target", "n_docs", rate.alias("rate"))
        .withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("mass", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * F.col("size"))
        .withColumn("mass", F.when(F.col("mass") < 1e-7, 0.0).otherwise(F.col("mass")))
    )
    left = rows.select("source", "n_docs", "doc_id", "nth", "size", "mass", "whole", "source_size", "target")
    done, level, groups = [left.filter("mass = 0").withColumn("more", F.lit(0.0))], 0, max(1, -(-(largest or 1) // fan))
    facts = ["source", "n_docs", "whole", "source_size", "target"]
    left = left.filter("mass > 0")
    while True:
        last = groups == 1
        # as many groups as the source's own rows need at this level
        own = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / float(fan) ** (level + 1))).cast("int")
        key = F.pmod(F.xxhash64(F.lit(level), "doc_id", "nth", "size"), own)
        item = F.struct((-F.col("size")).alias("big"), F.xxhash64(F.lit(SEED), "doc_id", "nth", "size").alias("h"), "doc_id", "nth", "size", "mass")
        met = left.groupBy(*facts, key.alias("key")).agg(F.sort_array(F.collect_list(item)).alias("xs"))
        met = met.withColumn("xs", F.expr("transform(xs, x -> named_struct('doc_id', x.doc_id, 'nth', x.nth, 'size', x.size, 'mass', x.mass))"))
        met = met.select(*facts, F.expr(_fold(level, last)).alias("r")).select(*facts, F.explode(F.expr("concat(transform(r.out, o -> named_struct('o', o, 'open', false)), CASE WHEN r.cur IS NULL THEN array() ELSE array(named_struct('o', r.cur, 'open', true)) END)")).alias("e"))
        met = stage(met.select(*facts, "e.o.*", "e.open"), f"mix-{level}")
        done.append(met.filter("NOT open").drop("open").withColumn("more", F.col("mass")))
        if last:
            break
        left, level, groups = met.filter("open").drop("open"), level + 1, max(1, -(-groups // fan))
    out = None
    for d in done:
        d = d.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.round("more")).cast("long").alias("taken"))
        out = d if out is None else out.unionByName(d)
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: how many words of each document the mix takes."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
