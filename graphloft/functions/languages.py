"""Languages by file name, and what counts as public in each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and the file extensions that mean them.
EXTENSIONS = {
    "Rust": "rs", "Python": "py", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts", "Tsx": "tsx", "Go": "go", "Java": "java", "C": "c h",
    "Cpp": "cpp cc cxx hpp hh hxx", "CSharp": "cs", "Kotlin": "kt kts", "Swift": "swift", "Scala": "scala sc", "Zig": "zig", "Ruby": "rb", "Php": "php",
    "Bash": "sh bash", "PowerShell": "ps1 psm1", "Lua": "lua", "Yaml": "yaml yml", "Toml": "toml", "Json": "json jsonc", "Properties": "properties",
    "Elixir": "ex exs", "Haskell": "hs", "Dart": "dart", "Sql": "sql", "Html": "html htm", "Css": "css", "R": "r R", "ArkTs": "ets", "ObjC": "m mm",
    "Metal": "metal", "Cuda": "cu cuh", "Svelte": "svelte", "Vue": "vue", "Astro": "astro", "Liquid": "liquid", "Pascal": "pas pp", "Luau": "luau",
    "Cfml": "cfm cfc", "Cobol": "cbl cob", "VisualBasic": "vb", "Erlang": "erl hrl", "Solidity": "sol", "Terraform": "tf tofu", "Nix": "nix",
}
BY_EXTENSION = {e: name for name, es in EXTENSIONS.items() for e in es.split()}
# How each language marks what it exports (all others export everything).
SAYS_EXPORT = ("JavaScript", "TypeScript", "Tsx", "ArkTs")
SAYS_PUBLIC = ("Java", "Kotlin", "CSharp", "Scala", "Swift", "Php", "VisualBasic")
NOT_STATIC = ("C", "Cpp", "ObjC", "Metal", "Cuda")
NO_UNDERSCORE = ("Python", "Dart")


def language(path: Column) -> Column:
    """The language of a path, null if none is known."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.when(name.startswith(".env"), F.lit("Properties")).otherwise(F.try_element_at(table, ext))


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if name.startswith(".env"):
        return "Properties"
    stem, dot, ext = name.rpartition(".")
    return BY_EXTENSION.get(ext) if dot and stem else None


def contract_short_name(symbol: Column) -> Column:
    """The last part of a symbol, split at colons and dots."""
    return F.regexp_extract(symbol, r"([^:.]*)$", 1)


def is_public(lang: Column, signature: Column, symbol: Column, unknown: bool = True) -> Column:
    """Whether a symbol is exported; `unknown` answers for paths of no known language."""
    sig, name = F.trim(signature), contract_short_name(symbol)
    return (
        F.when(lang.isNull(), F.lit(unknown))
        .when(lang == "Rust", sig.startswith("pub") & ~sig.startswith("pub("))
        .when(lang.isin(*NO_UNDERSCORE), ~name.startswith("_"))
        .when(lang == "Go", name.rlike("^[A-Z]"))
        .when(lang.isin(*SAYS_EXPORT), sig.contains("export"))
        .when(lang.isin(*SAYS_PUBLIC), F.lower(sig).contains("public"))
        .when(lang.isin(*NOT_STATIC), ~sig.startswith("static"))
        .when(lang == "Solidity", sig.contains("public") | sig.contains("external"))
        .when(lang == "Elixir", ~sig.contains("defp"))
        .when(lang == "Zig", sig.startswith("pub"))
        .otherwise(True)
    )
