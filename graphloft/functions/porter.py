"""The Porter stemmer, from its published definition, as a cached function and a column."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published suffix tables of steps 2, 3 and 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
_two, _three = ([tuple(x.split(":")) for x in s.split()] for s in (STEP2, STEP3))
_four = sorted([*STEP4.split(), "ion"], key=len, reverse=True)


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("v" if _vowel(w, i) else "c" for i in range(len(w)))
    return sum(1 for a, b in zip(shape, shape[1:]) if a == "v" and b == "c")


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_two, _three):
        for suffix, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + to
                break
    for suffix in _four:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    return w[:-1] if _measure(w) > 1 and w.endswith("ll") else w


def stem_column(term: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else stem(t))

    return run(term)
