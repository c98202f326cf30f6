"""Rule evaluation: boundaries, guards, phantoms, contracts, verification, review."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloft.functions.languages import contract_short_name, is_public, language
from graphloft.functions.text import canonical_line, short_name
from graphloft.operators.aggregate import contract_hash, orphan_files
from graphloft.operators.filters import Identity, any_glob, glob_matches, in_module
from graphloft.operators.mutation import upsert

# Verdicts with their exit codes, severities and risks in order.
EXIT = {"pass": 0, "fail": 1, "incomplete": 2}
SEVERITIES = ("info", "warning", "blocker")
RISKS = ("Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Rule:
    """A boundary: edges from one module to another that must not be, or must be."""

    kind: str
    source: str
    target: str
    allowed_roles: tuple[str, ...] = ()
    owner_role: str | None = None

    @staticmethod
    def load(spec: dict) -> Rule:
        """A rule from its document form; exactly one of disallow and require, with both ends."""
        kinds = [k for k in ("disallow", "require") if k in spec]
        if len(kinds) != 1:
            raise ValueError("a rule has exactly one of disallow and require")
        body = spec[kinds[0]]
        if not body.get("from") or not body.get("to"):
            raise ValueError("a rule has 'from' and 'to'")
        return Rule(kinds[0], body["from"], body["to"], tuple(spec.get("allowed_roles", ())), spec.get("owner_role"))

    @property
    def id(self) -> str:
        return f"{self.kind}:{self.source}->{self.target}"


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    """Rules as rows; a rule file has few."""
    return spark.createDataFrame([(r.kind, r.source, r.target, r.owner_role) for r in rules], "kind string, from string, to string, owner_role string")


def crossings(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, from, to, src, dst, a, b): edges that cross a rule's boundary."""
    at = nodes.select("id", "path")
    # Paths are few beside edges: rules are matched with pairs of paths first.
    e = edges.select("src", "dst").distinct().join(at.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    p = e.select("a", "b").distinct()
    hit = p.join(F.broadcast(rules), in_module(F.col("a"), F.col("from")) & in_module(F.col("b"), F.col("to")))
    return e.join(hit, ["a", "b"])


def lint(nodes: DataFrame, edges: DataFrame, rules: list[Rule], roles=(), samples: int = 5) -> DataFrame:
    """(kind, from, to, owner_role, n, samples) of broken rules: disallow with crossings, require without."""
    spark = nodes.sparkSession
    active = [r for r in rules if not set(r.allowed_roles) & set(roles)]
    if not active:
        return spark.createDataFrame([], "kind string, from string, to string, owner_role string, n long, samples array<string>")
    frame = rules_frame(spark, active)
    x = crossings(nodes, edges, frame)
    name = nodes.select("id", "symbol")
    first = x.withColumn("r", F.row_number().over(Window.partitionBy("kind", "from", "to").orderBy("src", "dst"))).filter(F.col("r") <= samples)
    first = first.join(name.select(F.col("id").alias("src"), F.col("symbol").alias("s")), "src").join(name.select(F.col("id").alias("dst"), F.col("symbol").alias("t")), "dst")
    shown = first.groupBy("kind", "from", "to").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("s", F.lit(" -> "), "t").alias("x")))), lambda v: v["x"]).alias("samples"))
    n = x.groupBy("kind", "from", "to").agg(F.count(F.lit(1)).alias("n"))
    all_ = frame.join(n, ["kind", "from", "to"], "left").fillna(0, ["n"]).join(shown, ["kind", "from", "to"], "left")
    return all_.filter(F.when(F.col("kind") == "disallow", F.col("n") > 0).otherwise(F.col("n") == 0)).select("kind", "from", "to", "owner_role", "n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def drift(nodes: DataFrame, edges: DataFrame, visible: Column | None = None) -> DataFrame:
    """(path, only_by_masking): orphan files of the view, and whether only masking makes them so."""
    from graphloft.operators.filters import drop_hidden

    if visible is None:
        return orphan_files(nodes, edges).withColumn("only_by_masking", F.lit(False))
    v, e = drop_hidden(nodes, edges, visible)
    real = orphan_files(nodes, edges).withColumn("_real", F.lit(True))
    return orphan_files(v, e).join(real, "path", "left").select("path", F.col("_real").isNull().alias("only_by_masking"))


def required_guards(nodes: DataFrame, edges: DataFrame, guards: list[dict]) -> DataFrame:
    """(symbol, caller, path): direct callers of guarded symbols that no allowed pattern covers."""
    out = None
    for g in guards:
        own = nodes.filter(F.col("symbol") == g["symbol"]).select(F.col("id").alias("dst"))
        ids = edges.join(own, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        allowed = F.col("symbol").isin(list(g.get("allow", []))) if g.get("allow") else F.lit(False)
        bad = nodes.join(ids, "id", "left_semi").filter(~allowed & ~any_glob(F.col("path"), g.get("allow_globs", ()))).select(F.lit(g["symbol"]).alias("symbol"), F.col("symbol").alias("caller"), "path")
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else nodes.sparkSession.createDataFrame([], "symbol string, caller string, path string")


def phantom_symbols(unresolved: DataFrame, paths: DataFrame | None = None, exempt=()) -> DataFrame:
    """Unresolved names of the files, but for exempt ones."""
    u = unresolved if paths is None else unresolved.join(paths.select("path"), "path", "left_semi")
    return u.filter(~any_glob(F.col("path"), exempt)).select("path", "short_name").distinct()


def encapsulation(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, source, target): edges from outside a module (prefix) to a symbol in it that is not public."""
    public = is_public(language(F.col("path")), F.col("signature"), F.col("symbol"), unknown=True)
    t = nodes.filter(~public).select(F.col("id").alias("dst"), F.col("path").alias("b"), F.col("symbol").alias("target")).join(modules.select("prefix"), in_module(F.col("b"), F.col("prefix")))
    s = nodes.select(F.col("id").alias("src"), F.col("path").alias("a"), F.col("symbol").alias("source"))
    return edges.select("src", "dst").distinct().join(t, "dst").join(s, "src").filter(~in_module(F.col("a"), F.col("prefix"))).select(F.col("prefix").alias("module"), "source", "target")


def contract_entries(nodes: DataFrame) -> DataFrame:
    """(symbol, entry_kind, signature, path, line): exported symbols by short name; the least path stands for equals."""
    public = is_public(language(F.col("path")), F.col("signature"), F.col("symbol"), unknown=True)
    a = nodes.filter(public).select(contract_short_name(F.col("symbol")).alias("symbol"), F.col("kind").alias("entry_kind"), F.trim("signature").alias("signature"), "path", F.col("line_start").alias("line"))
    return a.groupBy("symbol").agg(F.min(F.struct("path", "line", "entry_kind", "signature")).alias("m")).select("symbol", "m.entry_kind", "m.signature", "m.path", "m.line")


def entries_hash(entries: DataFrame) -> DataFrame:
    """(hash) over the canonical lines of entries."""
    return contract_hash(entries.select(canonical_line(F.col("entry_kind"), F.col("symbol"), F.col("signature")).alias("line")))


def contract_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(symbol, change, before, after): added, removed and changed entries."""
    e = expected.select("symbol", F.concat("entry_kind", F.lit(" "), "signature").alias("before"))
    a = actual.select("symbol", F.concat("entry_kind", F.lit(" "), "signature").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return e.join(a, "symbol", "full_outer").withColumn("change", change).filter("change IS NOT NULL").select("symbol", "change", "before", "after")


CONTRACT_KEY = ("service_a", "service_b", "protocol", "symbol")


def put_contracts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contracts once each pair of services in `new` has that record and nothing older."""
    return upsert(old, new, CONTRACT_KEY[:3])


def contract_between(contracts: DataFrame, a: str, b: str) -> DataFrame:
    """The entries recorded between two services, by symbol."""
    return contracts.filter((F.col("service_a") == a) & (F.col("service_b") == b)).orderBy("protocol", "symbol")


def scoped(diff: DataFrame, imported: DataFrame) -> DataFrame:
    """diff with in_scope: whether the consumer uses the symbol (added ones concern nobody yet)."""
    used = imported.select("symbol").distinct().withColumn("_u", F.lit(True))
    return diff.join(used, "symbol", "left").withColumn("in_scope", F.col("_u").isNotNull() & (F.col("change") != "added")).drop("_u")


def imported_symbols(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """(symbol): short names in a module that edges from outside use."""
    t = nodes.filter(in_module(F.col("path"), prefix)).select(F.col("id").alias("dst"), contract_short_name(F.col("symbol")).alias("symbol"))
    s = nodes.filter(~in_module(F.col("path"), prefix)).select(F.col("id").alias("src"))
    return edges.join(t, "dst").join(s, "src", "left_semi").select("symbol").distinct()


def check_contract(expected: DataFrame, actual: DataFrame, imported: DataFrame, policy: str = "warn", identity: Identity | None = None, reason: str = "") -> tuple[str, DataFrame]:
    """(verdict, diff): equal hashes pass; drift in scope fails under 'strict' unless waived with a reason."""
    if policy not in ("warn", "strict", "ignore"):
        raise ValueError(f"unknown policy {policy!r}")
    d = scoped(contract_diff(expected, actual), imported)
    if entries_hash(expected).first() == entries_hash(actual).first() or policy != "strict":
        return "pass", d
    if d.filter("in_scope").isEmpty():
        return "pass", d
    if identity is not None and waive(identity, reason):
        return "pass", d
    return "fail", d


def waive(identity: Identity, reason: str) -> bool:
    """Whether a finding may be waived: the role must allow it, and a reason must be given."""
    if not identity.can_waive:
        return False
    if not reason.strip():
        raise ValueError("a waiver needs a reason")
    return True


def truthy(value: str | None) -> bool:
    return (value or "").lower() in ("1", "true")


def verdict(findings: int, unproven: int) -> str:
    """Any finding fails; else anything unproven is incomplete; else it passes."""
    return "fail" if findings else "incomplete" if unproven else "pass"


def verdict_column(findings: Column, unproven: Column) -> Column:
    return F.when(findings > 0, "fail").when(unproven > 0, "incomplete").otherwise("pass")


def risk(impacted: Column, exported: Column) -> Column:
    """The class of a change by how many symbols it reaches and how many exported ones it touches."""
    return F.when((impacted >= 50) & (exported > 0), "Critical").when((impacted >= 50) | (exported >= 3), "High").when((impacted >= 10) | (exported > 0), "Medium").otherwise("Low")


def exported_touched(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Exported symbols of changed files."""
    public = is_public(language(F.col("path")), F.col("signature"), F.col("symbol"), unknown=True)
    return nodes.join(changed.select("path"), "path", "left_semi").filter(public)


@dataclass
class Review:
    """A change review: risk, findings (id, severity, text), what was waived, and the gate's outcome."""

    risk: str
    impacted: int
    exported: int
    findings: list[dict]
    waived: list[str] = field(default_factory=list)
    failed: bool = False


def review(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, changed: DataFrame, rules: list[Rule], identity: Identity = Identity(), waive_ids=(), reason: str = "", fail_on: str = "blocker", most: int = 200) -> Review:
    """Blast radius, risk, and the findings of every gate on a change."""
    from graphloft.operators.traverse import blast

    hit = blast(nodes, edges, changed, "callers", 2).count()
    exported = exported_touched(nodes, changed).count()
    level = "Critical" if hit >= 50 and exported else "High" if hit >= 50 or exported >= 3 else "Medium" if hit >= 10 or exported else "Low"
    found = []
    if hit > most:
        found.append({"id": "oversize", "severity": "warning", "text": f"reaches {hit} symbols"})
    for r in lint(nodes, edges, rules, identity.roles).orderBy("kind", "from", "to").collect():  # a row for each rule at most
        found.append({"id": f"policy:{r['kind']}:{r['from']}->{r['to']}", "severity": "blocker", "text": f"{r['n']} crossings"})
    n = phantom_symbols(unresolved, changed).count()
    if n:
        found.append({"id": "phantom", "severity": "warning", "text": f"{n} names that nothing defines"})
    waived = sorted(set(waive_ids) & {f["id"] for f in found}) if waive_ids and waive(identity, reason) else []
    left = [f for f in found if f["id"] not in waived]
    bar = SEVERITIES.index(fail_on)
    return Review(level, hit, exported, left, waived, any(SEVERITIES.index(f["severity"]) >= bar for f in left))


def stale_references(expected: DataFrame, actual: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported symbols that the provider removed or changed."""
    return scoped(contract_diff(expected, actual), imported).filter("in_scope").select("symbol", "change")
