"""Secret scans: base patterns, and character Markov models compared by likelihood.

First-order Markov models over characters are trained from labelled samples: one for each
family of random strings (label 1: hexadecimal, base32, base62, base64) and one for
ordinary identifiers (label 0: words in the usual ways of writing names, paths and
versions). A run of key characters scores, for each family, the sum over its transitions
of ``log P_random - log P_ordinary``; from ``THRESHOLD`` on for any family it is a span of
kind ``markov``, unless a base span covers some of it already.

No rule on length or content cuts runs off: an evidence of ``THRESHOLD`` needs a number of
transitions, since none contributes more than the tables' greatest entry, and only runs
that are too short for that are not scored.

All work is DataFrame functions over whole texts. A match's place follows from the
lengths of matches and of what lies between them, so one pass per pattern is enough.

Defined cases: a null text is empty and has no spans; rows are judged one by one, so
repeated rows and null ids are fine; other columns are kept, and those of the input that
have the name of an added one are left out.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.llm.common import numbers, table

#: The base patterns.
ASSIGN = r"""(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short fails whole, as it does in `AKIA[A-Z0-9]+`
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # likewise; runs are maximal
KINDS = ("assign", "access", "hex", "markov")
#: Characters of the runs that the models judge.
KEY = "A-Za-z0-9+/_-"
#: Evidence from which a run is a secret, in natural units.
THRESHOLD = 20.0
#: Share of each model's row that is dealt evenly, so that no transition is impossible.
FLOOR = 0.1
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Families of random strings, by their letters.
FAMILIES = {
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base62": LOWER + UPPER + DIGITS,
    "base64": LOWER + UPPER + DIGITS + "+/-_",
}
#: Characters by their codes; a table has a row and a column for each.
ALPHABET = LOWER + UPPER + DIGITS + "+/-_"
#: Words that ordinary identifiers and texts are made of.
WORDS = """
user name count index value list map file path line column order customer number region price total amount address
buffer decode encode string parse timestamp digest length server connection client request response header session
timeout config default version release build test case module function class method object field table query result
window page title section chapter summary the and with from that this have would there their which about other into
time people water between through however information government international development understanding particularly
administration responsibility characteristics communication independent environment relationship knowledge strength
und der die das nicht werden zwischen gesellschaft entwicklung wissenschaft geschichte verantwortung moeglichkeit
les des une pour dans avec plus entre aux eaux eux deux yeux mieux choix voix toujours cependant connaissance gouvernement developpement environnement
los las una para como pero entre siempre gobierno desarrollo conocimiento informacion responsabilidad universidad
thing rest station nation ment tion ing ness able ence ation
""".split()


def _stream(what: str):
    """Whole numbers from a fixed stream, below what is asked for."""
    pool, n = b"", 0
    while True:
        below = yield
        if len(pool) < 4:
            pool, n = pool + hashlib.sha512(f"{what} {n}".encode()).digest(), n + 1
        yield int.from_bytes(pool[:4], "big") % below
        pool = pool[4:]


def _drawer(what: str):
    stream = _stream(what)

    def draw(below: int) -> int:
        next(stream)
        return stream.send(below)

    return draw


def labelled(n: int = 3000) -> list[tuple[str, str | None]]:
    """The training sample: n random strings of each family, and 4 n identifiers (None)."""
    out, draw = [], _drawer("random strings")
    for family, letters in FAMILIES.items():
        out += [("".join(letters[draw(len(letters))] for _ in range(16 + draw(30))), family) for _ in range(n)]
    draw = _drawer("identifiers")
    joins = ("_", "-", "/", "", "", "_", "-")
    for _ in range(4 * n):
        words = [WORDS[draw(len(WORDS))] for _ in range(1 + draw(4))]
        if draw(3) == 0:
            words.insert(draw(len(words) + 1), str(draw((10, 100, 3000, 100_000)[draw(4)])))
        how = draw(7)
        if how == 3:
            words = [w.capitalize() for w in words]
        elif how == 4:
            words = [words[0], *[w.capitalize() for w in words[1:]]]
        elif how == 5:
            words = [w.upper() for w in words]
        elif draw(4) == 0:
            words[0] = words[0].capitalize()
        out.append((joins[how].join(words), None))
    return out


def train(sample: list[tuple[str, str | None]]) -> dict[str, list[float]]:
    """For each family the log ratio of each transition (row-major over codes), random against ordinary.

    Ratios are kept to two decimals: the tables are part of the query's plan.
    """
    codes = len(ALPHABET)
    seen: dict[str | None, list[list[float]]] = {}
    for text, label in sample:
        rows = seen.setdefault(label, [[0.0] * codes for _ in range(codes)])
        known = [ALPHABET.index(c) for c in text]
        for i, j in zip(known, known[1:]):
            rows[i][j] += 1

    def model(rows):
        out = []
        for row in rows:
            total = sum(row)
            share = FLOOR if total else 1.0
            out += [share / codes + (1 - share) * (x / total if total else 0.0) for x in row]
        return out

    usual = model(seen.pop(None))
    return {label: [round(math.log(x / y), 2) for x, y in zip(model(rows), usual)] for label, rows in seen.items()}


def shortest(models: dict[str, list[float]], threshold: float) -> int:
    """Characters of the shortest run that can reach the threshold."""
    return 1 + max(1, math.ceil(threshold / max(max(m) for m in models.values())))


def found(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, hit) of the non-overlapping matches, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    state = "struct<at:int,out:array<struct<start:int,end:int,hit:string>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out")).cast(state)

    def place(s, x):
        start = s["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out")).cast(state)

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, place)["out"]).otherwise(zero["out"])


#: Columns that scan() adds.
ADDED = ("n_assign", "n_access", "n_hex", "n_markov", "base", "marks")


def _scanned(docs: DataFrame, threshold: float, models: dict[str, list[float]] | None) -> DataFrame:
    """Columns c0, c1, ... of docs in order, then ADDED."""
    models = models or train(labelled())
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(own[docs.columns.index("text")]), F.lit(""))
    # the place of each transition in the tables
    code = lambda x, i: F.instr(F.lit(ALPHABET), F.substring(x, i, F.lit(1)))
    step = lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: (code(x, i) - 1) * len(ALPHABET) + code(x, i + 1) - 1)
    evidence = lambda x, ratio: F.aggregate(x["at"], F.lit(0.0), lambda s, i: s + F.get(ratio, i))
    most = numbers([max(x) for x in zip(*models.values())])  # no family's evidence is above this table's
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[{KEY}]{{{shortest(models, threshold)},}}+"), F.lit(0)))
    a = docs.toDF(*own).select("*", found(text, ASSIGN).alias("assign"), found(text, ACCESS).alias("access"), found(text, HEX).alias("hex"), F.transform(runs, lambda x: F.struct(x.alias("run"), step(x).alias("at"))).alias("run"))
    a = a.withColumn("run", F.filter("run", lambda x: evidence(x, most) >= threshold))
    a = a.withColumn("run", F.transform(F.filter("run", lambda x: F.greatest(*[evidence(x, numbers(m)) for m in models.values()]) >= threshold), lambda x: x["run"]))
    # only the runs found are looked for again, for their places
    again = F.concat(F.lit(rf"(?<![{KEY}])(?:\Q"), F.array_join("run", r"\E|\Q"), F.lit(rf"\E)(?![{KEY}])"))
    a = a.withColumn("run", F.when(F.size("run") > 0, found(text, again)))

    def spans(col, kind):
        return F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    secret = F.filter("assign", lambda x: F.char_length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= 6)
    b = a.select(*own, "run", *[spans(c, k).alias(k) for k, c in (("assign", secret), ("access", F.col("access")), ("hex", F.col("hex")))])
    b = b.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = F.filter(F.coalesce("run", F.array()), lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    d = b.withColumn("found", spans(free, "markov"))
    counts = [F.size(k).cast("long").alias(f"n_{n}") for k, n in (("assign", "assign"), ("access", "access"), ("hex", "hex"), ("found", "markov"))]
    return d.select(*own, *counts, "base", F.array_sort(F.concat("base", "found")).alias("marks"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, models: dict[str, list[float]] | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_markov, base (array) and marks (array) of spans."""
    out = _scanned(docs, threshold, models)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ADDED], *ADDED)


def joined(marks: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(marks, lambda x: F.concat_ws(":", kind(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("marks")).alias("spans"), "n_markov")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: every document stays, each secret in it replaced by [SECRET].

    Overlapping spans are one; n_chars, where there is such a column, follows the text.
    """
    a = _scanned(docs, THRESHOLD, None).withColumn("text", F.col(f"c{docs.columns.index('text')}"))
    state = "struct<at:int,out:array<string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    cut = lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit("[SECRET]"))).alias("out"))).cast(state)
    whole = F.aggregate("marks", zero, cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.size("marks") > 0, whole).otherwise(F.col("text"))
    b = a.withColumn("text", text)
    return b.select(*[F.col("text") if c == "text" else (F.when(F.size("marks") > 0, F.char_length("text")).otherwise(F.col(f"c{i}")).cast(t).alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c)) for i, (c, t) in enumerate(docs.dtypes)])
