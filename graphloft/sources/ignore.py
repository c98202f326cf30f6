"""Ignore files: patterns that keep paths out of a walk, as one column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One pattern of an ignore file in folder `base` ('' is the root)."""

    base: str
    pattern: str
    negated: bool
    folders_only: bool

    def regex(self) -> str:
        anchored = "/" in self.pattern.rstrip("/")
        body = _glob(self.pattern.strip("/"))
        lead = re.escape(self.base) + "/" if self.base else ""
        return f"^{lead}{'' if anchored else '(?:.*/)?'}{body}$"


def _glob(text: str) -> str:
    """A glob as a regular expression: '*' and '?' stay within a name, '**' crosses folders."""
    out, i = [], 0
    while i < len(text):
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif text.startswith("**", i):
            out.append(".*")
            i += 2
        elif text[i] == "*":
            out.append("[^/]*")
            i += 1
        elif text[i] == "?":
            out.append("[^/]")
            i += 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            inner = text[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
            i = end + 1
        else:
            i += text[i] == "\\" and i + 1 < len(text)
            out.append(re.escape(text[i]))
            i += 1
    return "".join(out)


def rules(base: str, text: str) -> list[Rule]:
    """The rules of one ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        if line.strip("/"):
            out.append(Rule(base, line, negated, line.endswith("/")))
    return out


def ignored(path: Column, known: list[Rule]) -> Column:
    """Whether a path, or a folder above it, is left out; of several rules that match a name the last decides.

    Rules of deeper folders come after those of folders above, whatever order they are given in.
    """
    if not known:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("name"), (i < F.size(parts)).alias("folder")))

    def out(x):
        state = F.lit(False)
        for r in sorted(known, key=lambda r: r.base.count("/") + bool(r.base)):
            hit = x["name"].rlike(r.regex())
            state = F.when(hit & x["folder"] if r.folders_only else hit, not r.negated).otherwise(state)
        return state

    return F.exists(above, out)
