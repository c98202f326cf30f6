"""Language scanners: one table of patterns per family, and how its blocks end.

No grammar library is assumed. Python is read by its own parser; every other language by
declaration patterns over text whose strings and comments are blanked (lengths and lines
stay), with blocks closed by braces, by indentation or by ``end``. Rows are
(symbol, kind, line_start, line_end, signature), (source, name, is_member) for calls, and
(source, name, kind) for structure; symbols are scoped with '::'.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field

MODULE = "<module>"


@dataclass
class Parsed:
    symbols: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    structure: list[tuple] = field(default_factory=list)


def _squash(text: str) -> str:
    return " ".join(text.split())


# Python


def python(text: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out

    def leaf(node):
        return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None

    def header(node):
        last = max(node.lineno, (node.body[0].lineno - 1) if node.body[0].lineno > node.lineno else node.lineno)
        head = _squash(" ".join(lines[node.lineno - 1 : last]))
        return re.sub(r":\s*(#.*)?$", "", head.split(":\n")[0]) if node.body[0].lineno > node.lineno else head

    def walk(node, scope, in_class, owner):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = "::".join([*scope, n.name])
                is_class = isinstance(n, ast.ClassDef)
                out.symbols.append((name, "class" if is_class else "method" if in_class else "function", n.lineno, n.end_lineno, header(n)))
                if is_class:
                    out.structure.extend((name, b, "INHERITS") for b in map(leaf, n.bases) if b)
                walk(n, [*scope, n.name], is_class, name)
                continue
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                out.structure.extend((owner, a.name.rsplit(".", 1)[-1], "IMPORTS") for a in n.names)
            if isinstance(n, ast.Call) and (f := leaf(n.func)):
                out.calls.append((owner, f, isinstance(n.func, ast.Attribute)))
            walk(n, scope, in_class and not isinstance(n, ast.stmt), owner)

    walk(tree, [], False, MODULE)
    return out


# Languages by declaration patterns


@dataclass(frozen=True)
class Grammar:
    """declares: (kind, pattern with group 'name'); kind 'scope' names no symbol. block: braces, end or none."""

    declares: tuple[tuple[str, str], ...]
    structure: tuple[tuple[str, str], ...] = ()
    block: str = "braces"
    comments: tuple[str, ...] = ("//", "/* */")
    in_class: tuple[str, ...] = ("class", "interface", "struct", "impl")
    calls: str = r"(?P<member>(?:\.|->|::)\s*)?\b(?P<name>[A-Za-z_$][\w$]*)\s*\("


_ID = r"(?P<name>[A-Za-z_$][\w$]*)"
_CALL_WORDS = frozenset("if for while switch return catch match function fn func def sizeof typeof new in and or not elif else when until unless with do throw await yield assert super".split())
_CONTROL = frozenset("if for while switch catch return sizeof do else".split())
_TYPE = r"(?:[A-Za-z_][\w:<>,&*\[\]\s.?]*?[\s&*>\]])"
_ECMA = Grammar(
    (("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}[^{{;]*(?=\{{)"), ("interface", rf"(?:export\s+)?interface\s+{_ID}[^{{;]*(?=\{{)"), ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}\s*\([^)]*\)[^{{;]*(?=\{{)"),
     ("function", rf"(?:export\s+)?(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>\s*(?=\{{)"), ("member", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?!(?:if|for|while|switch|catch|function|return|else|do)\b)#?{_ID}\s*\([^()]*\)\s*(?::[^{{;=]+)?(?=\{{)")),
    (("INHERITS", r"class\s+[\w$]+(?:<[^>]*>)?\s+extends\s+(?P<name>[\w$.]+)"), ("IMPLEMENTS", r"class\s+[^{]*?\bimplements\s+(?P<name>[\w$.,\s]+)"), ("IMPORTS", r"import\s+(?:type\s+)?(?:[\w$*\s{},]+\s+from\s+)?@(?P<name>[^@\n]+)@"), ("IMPORTS", r"require\(\s*@(?P<name>[^@\n]+)@\s*\)"), ("IMPORTS", r"process\.env\.(?P<name>\w+)")),
)
_CFAMILY_FN = rf"^[ \t]*(?!return\b|else\b|new\b|delete\b|throw\b)(?:[\w:<>,*&\[\]~]+[\s*&]+)+(?P<name>~?[A-Za-z_][\w:]*)\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?=\{{)"
_CPP = Grammar(
    (("scope", rf"namespace\s+{_ID}\s*(?=\{{)"), ("class", rf"\bclass\s+{_ID}[^;{{(]*(?=\{{)"), ("struct", rf"\bstruct\s+{_ID}[^;{{(]*(?=\{{)"), ("function", _CFAMILY_FN)),
    (("INHERITS", r"(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*(?P<name>[^{]+)"), ("IMPORTS", r"#\s*include\s+[@<](?P<name>[^@>\n]+)[@>]")),
)
_JVM_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|partial|data|readonly|suspend|inline|synchronized|native|default|unsafe|extern)\s+)*"

GRAMMARS: dict[str, Grammar] = {
    "Rust": Grammar(
        (("scope", rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+{_ID}\s*(?=\{{)"), ("scope:impl", r"impl(?:<[^>{]*>)?\s+(?:[\w:<>,\s&']+\s+for\s+)?(?P<name>\w+)[^{;]*(?=\{)"), ("scope", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_ID}[^{{;]*(?=\{{)"),
         ("struct", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}[^{{;]*(?=[{{;])"), ("function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:@[^@]*@\s+)?)*fn\s+{_ID}[^{{;]*(?=\{{)")),
        (("IMPLEMENTS", r"impl(?:<[^>{]*>)?\s+(?P<name>[\w:]+)(?:<[^>]*>)?\s+for\s+"), ("IMPORTS", r"\buse\s+(?P<name>[^;]+);"), ("IMPORTS", r"env!\(\s*@(?P<name>\w+)@")), calls=r"(?P<member>\.\s*)?\b(?P<name>[A-Za-z_]\w*)\s*\("),
    "JavaScript": _ECMA, "TypeScript": _ECMA, "Tsx": _ECMA, "ArkTs": _ECMA,
    "Go": Grammar(
        (("struct", rf"type\s+{_ID}\s+struct\s*(?=\{{)"), ("interface", rf"type\s+{_ID}\s+interface\s*(?=\{{)"), ("receiver", r"func\s*\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\([^{]*(?=\{)"), ("function", rf"func\s+{_ID}\s*(?:\[[^\]]*\])?\([^{{]*(?=\{{)")),
        (("IMPORTS", r"import\s+(?:\w+\s+)?@(?P<name>[^@\n]+)@"), ("IMPORTS", r"^\s+(?:[\w.]+\s+)?@(?P<name>[\w./-]+)@\s*$"))),
    "Java": Grammar((("class", rf"{_JVM_MOD}(?:class|record|enum)\s+{_ID}[^{{;]*(?=\{{)"), ("interface", rf"{_JVM_MOD}interface\s+{_ID}[^{{;]*(?=\{{)"), ("member", rf"^[ \t]*{_JVM_MOD}(?:<[^>]*>\s*)?(?!return\b|new\b|else\b|throw\b){_TYPE}?{_ID}\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{)")),
                    (("INHERITS", r"class\s+\w+(?:<[^>]*>)?\s+extends\s+(?P<name>[\w.]+)"), ("IMPLEMENTS", r"class\s+[^{]*?\bimplements\s+(?P<name>[\w.,\s<>]+)"), ("IMPORTS", r"import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"))),
    "C": Grammar((("struct", rf"\bstruct\s+{_ID}\s*(?=\{{)"), ("function", _CFAMILY_FN)), (("IMPORTS", r"#\s*include\s+[@<](?P<name>[^@>\n]+)[@>]"),)),
    "Cpp": _CPP, "ObjC": _CPP, "Metal": _CPP, "Cuda": _CPP,
    "CSharp": Grammar((("scope", r"namespace\s+(?P<name>[\w.]+)\s*(?=\{)"), ("class", rf"{_JVM_MOD}(?:class|record|struct)\s+{_ID}[^{{;(]*(?=\{{)"), ("interface", rf"{_JVM_MOD}interface\s+{_ID}[^{{;]*(?=\{{)"), ("member", rf"^[ \t]*{_JVM_MOD}(?!return\b|new\b|else\b|throw\b){_TYPE}?{_ID}\s*\([^;{{}}]*\)\s*(?:where[^{{]*)?(?=\{{)")),
                      (("INHERITS", r"(?:class|interface|struct|record)\s+\w+(?:<[^>]*>)?\s*:\s*(?P<name>[^{]+)"), ("IMPORTS", r"\busing\s+(?:static\s+)?(?P<name>[\w.]+)\s*;"))),
    "Kotlin": Grammar((("interface", rf"{_JVM_MOD}interface\s+{_ID}[^{{\n]*(?=\{{)"), ("class", rf"{_JVM_MOD}(?:enum\s+|annotation\s+)?(?:class|object)\s+{_ID}[^{{\n]*(?=\{{|$)"), ("function", rf"{_JVM_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?{_ID}\s*\([^)]*\)[^{{\n=]*(?=\{{|=)")),
                      (("INHERITS", r"(?:class|object|interface)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*(?P<name>[^{\n]+)"), ("IMPORTS", r"^import\s+(?P<name>[\w.*]+)"))),
    "Swift": Grammar((("interface", rf"{_JVM_MOD}protocol\s+{_ID}[^{{]*(?=\{{)"), ("class", rf"{_JVM_MOD}(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b){_ID}[^{{]*(?=\{{)"), ("function", rf"{_JVM_MOD}(?:mutating\s+)?func\s+{_ID}[^{{\n]*(?=\{{|$)")),
                     (("INHERITS", r"(?:class|struct|enum|protocol|extension)\s+\w+\s*:\s*(?P<name>\w+)"), ("IMPORTS", r"^import\s+(?P<name>[\w.]+)"))),
    "Scala": Grammar((("interface", rf"(?:sealed\s+)?trait\s+{_ID}[^{{\n]*(?=\{{|$)"), ("class", rf"(?:final\s+|sealed\s+|abstract\s+|case\s+)*(?:class|object)\s+{_ID}[^{{\n]*(?=\{{|$)"), ("function", rf"(?:override\s+|private\s+|protected\s+|final\s+)*def\s+{_ID}[^{{\n=]*(?=[{{=])")),
                     (("INHERITS", r"(?:class|object|trait)\s+\w+(?:\[[^\]]*\])?(?:\([^)]*\))?\s+extends\s+(?P<name>\w+)"), ("IMPORTS", r"^\s*import\s+(?P<name>[\w.]+)"))),
    "Zig": Grammar((("struct", rf"(?:pub\s+)?const\s+{_ID}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union|enum)[^{{;]*(?=\{{)"), ("function", rf"(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+{_ID}\s*\([^{{;]*(?=\{{)")), (("IMPORTS", r"@import\(\s*@(?P<name>[^@\n]+)@"),), comments=("//",)),
    "Php": Grammar((("class", rf"(?:abstract\s+|final\s+)*(?:class|trait)\s+{_ID}[^{{;]*(?=\{{)"), ("interface", rf"interface\s+{_ID}[^{{;]*(?=\{{)"), ("function", rf"{_JVM_MOD}function\s+&?{_ID}\s*\([^{{;]*(?=\{{)")),
                   (("INHERITS", r"class\s+\w+\s+extends\s+(?P<name>[\w\\]+)"), ("IMPLEMENTS", r"class\s+[^{]*?\bimplements\s+(?P<name>[\w\\,\s]+)"), ("IMPORTS", r"\b(?:require|include)(?:_once)?\s*\(?\s*@(?P<name>[^@\n]+)@")), comments=("//", "#", "/* */")),
    "Dart": Grammar((("class", rf"(?:abstract\s+)?class\s+{_ID}[^{{;]*(?=\{{)"), ("interface", rf"mixin\s+{_ID}[^{{;]*(?=\{{)"), ("impl", rf"extension\s+{_ID}\s+on\s+[^{{;]*(?=\{{)"), ("member", rf"^[ \t]*(?:static\s+|factory\s+|const\s+|override\s+)*(?!return\b|new\b|else\b|throw\b){_TYPE}?{_ID}\s*\([^;{{}}]*\)\s*(?:async\s*)?(?=\{{|=>)")),
                    (("INHERITS", r"class\s+\w+(?:<[^>]*>)?\s+extends\s+(?P<name>\w+)"), ("INHERITS", r"\bwith\s+(?P<name>[\w,\s]+)(?=\{|implements)"), ("IMPLEMENTS", r"\bimplements\s+(?P<name>[\w,\s]+)"), ("IMPORTS", r"import\s+@(?P<name>[^@\n]+)@"))),
    "Solidity": Grammar((("class", rf"(?:abstract\s+)?(?:contract|library)\s+{_ID}[^{{;]*(?=\{{)"), ("interface", rf"interface\s+{_ID}[^{{;]*(?=\{{)"), ("function", rf"function\s+{_ID}\s*\([^{{;]*(?=\{{)")), (("INHERITS", r"contract\s+\w+\s+is\s+(?P<name>[^{]+)"), ("IMPORTS", r"import\s+@(?P<name>[^@\n]+)@"))),
    "Bash": Grammar((("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*(?=\{)"),), comments=("#",), calls=r"^[ \t]*(?P<member>(?!))?(?P<name>[A-Za-z_][\w-]*)(?=\s|$)"),
    "PowerShell": Grammar((("function", r"\bfunction\s+(?P<name>[\w:-]+)[^{]*(?=\{)"),), comments=("#", "<# #>"), calls=r"^[ \t]*(?P<member>(?!))?(?P<name>[A-Za-z]+-[A-Za-z]+)\b"),
    "R": Grammar((("function", r"(?P<name>[A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\s*\([^{]*(?=\{)"), ("class", r"(?:<-|=)\s*(?:setRefClass|R6Class|setClass|setGeneric)\(\s*@(?P<name>[^@\n]+)@(?=)"), ("class", r"(?:setRefClass|R6Class|setClass|setGeneric)\(\s*@(?P<name>[^@\n]+)@(?=)")), (("IMPORTS", r"\b(?:library|require)\(\s*@?(?P<name>[\w.]+)@?\s*\)"),), comments=("#",)),
    "Ruby": Grammar((("scope", r"^[ \t]*module\s+(?P<name>[\w:]+)"), ("class", r"^[ \t]*class\s+(?P<name>[\w:]+)[^\n]*"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=]+)[^\n]*")), (("INHERITS", r"class\s+[\w:]+\s*<\s*(?P<name>[\w:]+)"),), block="end", comments=("#",)),
    "Lua": Grammar((("function", r"(?:local\s+)?function\s+(?P<name>[A-Za-z_]\w*)\s*\([^\n]*?\)"),), block="end", comments=("--",)),
    "Elixir": Grammar((("class", r"^[ \t]*defmodule\s+(?P<name>[\w.]+)"), ("interface", r"^[ \t]*defprotocol\s+(?P<name>[\w.]+)"), ("impl", r"^[ \t]*defimpl\s+(?P<name>[\w.]+)[^\n]*"), ("function", r"^[ \t]*(?:defp?|defmacrop?)\s+(?P<name>[\w?!]+)[^\n]*")),
                      (("IMPLEMENTS", r"@behaviour\s+(?P<name>[\w.]+)"), ("IMPLEMENTS", r"defimpl\s+(?P<name>[\w.]+)"), ("IMPORTS", r"^\s*(?:alias|import|require|use)\s+(?P<name>[\w.]+)")), block="end", comments=("#",)),
    "VisualBasic": Grammar((("class", r"(?i)^[ \t]*(?:public\s+|private\s+|friend\s+)*(?:class|module|structure)\s+(?P<name>\w+)"), ("interface", r"(?i)^[ \t]*(?:public\s+|private\s+)*interface\s+(?P<name>\w+)"), ("function", r"(?i)^[ \t]*(?:public\s+|private\s+|shared\s+|overrides\s+)*(?:sub|function)\s+(?P<name>\w+)[^\n]*")), (("INHERITS", r"(?i)^\s*inherits\s+(?P<name>[\w.]+)"), ("IMPLEMENTS", r"(?i)^\s*implements\s+(?P<name>[\w.]+)"), ("IMPORTS", r"(?i)^\s*imports\s+(?P<name>[\w.]+)")), block="none", comments=("'",)),
    "Haskell": Grammar((("struct", r"^(?:data|newtype)\s+(?P<name>\w+)[^\n]*"), ("interface", r"^class\s+(?:[^\n]*=>\s*)?(?P<name>\w+)[^\n]*"), ("function", r"^(?P<name>[a-z_][\w']*)\s*::[^\n]*")), (("IMPORTS", r"^import\s+(?:qualified\s+)?(?P<name>[\w.]+)"),), block="none", comments=("--", "{- -}")),
    "Pascal": Grammar((("function", r"(?i)\b(?:function|procedure)\s+(?P<name>[\w.]+)[^;]*"), ("class", r"(?i)(?P<name>\w+)\s*=\s*class\b[^\n]*")), (("IMPORTS", r"(?i)\buses\s+(?P<name>[^;]+)"),), block="none", comments=("//", "{ }", "(* *)")),
    "Erlang": Grammar((("function", r"^(?P<name>[a-z]\w*)\([^\n]*?\)[^\n]*?->"),), (("IMPORTS", r"-(?:include|include_lib)\(\s*@(?P<name>[^@\n]+)@"), ("IMPORTS", r"-import\(\s*(?P<name>\w+)")), block="none", comments=("%",)),
    "Cobol": Grammar((("class", r"(?im)^.{0,7}PROGRAM-ID\.\s+(?P<name>[\w-]+)"), ("function", r"(?im)^.{0,7}(?P<name>[A-Z][\w-]*)\s+SECTION\.")), (("IMPORTS", r"(?i)\bCOPY\s+(?P<name>[\w-]+)"),), block="none", comments=()),
    "Terraform": Grammar((("struct", r"^(?:resource|data)\s+@[^@\n]+@\s+@(?P<name>[^@\n]+)@\s*(?=\{)"), ("struct", r"^(?:variable|output|module|provider)\s+@(?P<name>[^@\n]+)@\s*(?=\{)")), (("IMPORTS", r"\bsource\s*=\s*@(?P<name>[^@\n]+)@"),), comments=("#", "//", "/* */")),
    "Nix": Grammar((("function", r"(?P<name>[A-Za-z_][\w-]*)\s*=\s*(?:\{[^}=]*\}|[A-Za-z_]\w*)\s*:"),), (("IMPORTS", r"\bimport\s+(?P<name>[\w./<>-]+)"),), block="none", comments=("#", "/* */")),
}
GRAMMARS["Luau"] = GRAMMARS["Lua"]
_CALL_ALL = {"Bash", "PowerShell"}


def blank(text: str, comments: tuple[str, ...]) -> tuple[str, str]:
    """(text without comments and with string quotes as '@', the same with strings emptied too)."""
    kept, bare = list(text), list(text)
    line = [c for c in comments if " " not in c]
    pairs = [c.split(" ") for c in comments if " " in c]
    i, n = 0, len(text)

    def wipe(a, b, both=True):
        for j in range(a, b):
            if text[j] != "\n":
                bare[j] = " "
                if both:
                    kept[j] = " "

    while i < n:
        mark = next((c for c in line if text.startswith(c, i)), None)
        pair = next((p for p in pairs if text.startswith(p[0], i)), None)
        if pair:
            end = text.find(pair[1], i + len(pair[0]))
            end = n if end < 0 else end + len(pair[1])
            wipe(i, end)
            i = end
        elif mark and not (mark == "#" and text.startswith("#include", i)):
            end = text.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif text[i] in "\"'`":
            q, j = text[i], i + 1
            while j < n and text[j] != q and not (q != "`" and text[j] == "\n"):
                j += 2 if text[j] == "\\" else 1
            if j < n and text[j] == q:
                wipe(i + 1, j, both=False)
                kept[i] = kept[j] = "@"
                bare[i] = bare[j] = "@"
                i = j + 1
            else:
                i += 1
        else:
            i += 1
    return "".join(kept), "".join(bare)


def _close(bare: str, at: int, block: str) -> int:
    """Where the block that opens at or after `at` ends."""
    if block == "braces":
        i = at
        while i < len(bare) and bare[i] not in "{;\n":
            i += 1
        if i >= len(bare) or bare[i] != "{":
            return at
        depth = 0
        for j in range(i, len(bare)):
            depth += (bare[j] == "{") - (bare[j] == "}")
            if not depth:
                return j
        return len(bare) - 1
    if block == "end":
        depth, i = 0, bare.rfind("\n", 0, at) + 1
        for m in re.finditer(r"(?m)^[ \t]*(?:local\s+)?(?:class|module|def\w*|if|unless|while|until|case|begin|for|function)\b(?![^\n]*\b(?:then|do:?)\b[^\n]*\bend\b)|\bdo\b(?!:)[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|\bend\b|[=(,]\s*function\b", bare[i:]):
            word = m.group(0).strip()
            if word == "end":
                depth -= 1
                if depth <= 0:
                    return i + m.end() - 1
            elif not (word.startswith("do") and depth and re.match(r"[ \t]*(?:while|until|for|def\w*|if|unless|case)\b", bare[bare.rfind("\n", 0, i + m.start()) + 1 :])):
                depth += 1
    end = bare.find("\n", at)
    return (len(bare) if end < 0 else end) - 1


def by_grammar(text: str, lang: str) -> Parsed:
    g, out = GRAMMARS[lang], Parsed()
    kept, bare = blank(text, g.comments)
    line = lambda i: text.count("\n", 0, i) + 1
    found = []
    for kind, pattern in g.declares:
        for m in re.finditer(pattern, kept, re.M):
            at = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
            found.append((at, -m.end(), kind, m))
    found.sort(key=lambda x: x[:2])
    scopes: list[tuple[int, str, str]] = []  # (end, name, kind)
    spans, taken = [], set()
    for at, _, kind, m in found:
        name = m.group("name").strip()
        if m.start("name") in taken or name in _CONTROL:
            continue
        while scopes and scopes[-1][0] < at:
            scopes.pop()
        inside = bool(scopes) and scopes[-1][2] in (*g.in_class, "scope:impl")
        if kind == "member" and not inside and lang not in ("Java", "CSharp", "Dart"):
            continue
        taken.add(m.start("name"))
        end = max(_close(bare, m.end(), g.block), m.end() - 1)
        path = [s[1] for s in scopes]
        if kind == "receiver":
            path, inside = [m.group("owner")], True
        full = "::".join([*path, *re.split(r"::", name)])
        shown = {"function": "method" if inside else "function", "member": "method" if inside else "function", "receiver": "method"}.get(kind, kind)
        if not kind.startswith("scope"):
            raw = text[at : m.end()]
            out.symbols.append((full, shown, line(at), line(end), _squash(raw)))
            spans.append((at, end, full, m.start("name")))
        scopes.append((end, name, "class" if kind in ("class", "interface", "struct", "impl") else kind))
    owner = lambda i: next((s for a, b, s, _ in reversed(spans) if a <= i <= b), MODULE)
    names = {n for *_, n in spans}
    for m in re.finditer(g.calls, bare, re.M):
        name = m.group("name")
        if m.start("name") not in names and (lang in _CALL_ALL or name not in _CALL_WORDS):
            member = (m.group("member") or "").strip() in (".", "->")
            out.calls.append((owner(m.start("name")), name, member))
    for kind, pattern in g.structure:
        for m in re.finditer(pattern, kept, re.M):
            for part in re.split(r"[,{}]", m.group("name")):
                part = re.sub(r"<.*|\(.*|\bas\b.*", "", part).strip()
                part = re.sub(r"^(?:public|private|protected|virtual)\s+", "", part)
                if kind != "IMPORTS" or lang in ("Rust", "Java", "Kotlin", "Scala"):
                    part = re.split(r"::|\.|\\", part)[-1]
                if part and part not in ("self", "*"):
                    out.structure.append((owner(m.start()), part, kind))
    return out


# Data, style and markup languages


def sql(text: str) -> Parsed:
    out = Parsed()
    kept, _ = blank(text, ("--", "/* */"))
    kinds = {"TABLE": "struct", "VIEW": "interface", "INDEX": "impl", "TRIGGER": "impl", "FUNCTION": "function", "PROCEDURE": "function", "TYPE": "struct", "SCHEMA": "class"}
    for m in re.finditer(r"(?i)\b(CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|UNIQUE\s+|MATERIALIZED\s+)*(TABLE|VIEW|INDEX|TRIGGER|FUNCTION|PROCEDURE|TYPE|SCHEMA)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"@`\[\]]+))[^;]*;?", kept):
        name = re.sub(r"[\"@`\[\]]", "", m.group(3))
        out.symbols.append((name, kinds[m.group(2).upper()], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end() - 1) + 1, _squash(m.group(1))))
        body = m.group(0)[len(m.group(1)) :]
        word = r"(?i)\bREFERENCES\s+([\w.]+)" if m.group(2).upper() == "TABLE" else r"(?i)\b(?:FROM|JOIN|ON)\s+([\w.]+)"
        if m.group(2).upper() in ("TABLE", "VIEW", "INDEX", "TRIGGER"):
            out.structure.extend((name, r, "IMPORTS") for r in dict.fromkeys(re.findall(word, body)))
    for m in re.finditer(r"(?i)\bALTER\s+TABLE\s+([\w.]+)[^;]*?\bREFERENCES\s+([\w.]+)", kept):
        out.structure.append((m.group(1), m.group(2), "IMPORTS"))
    return out


def html(text: str) -> Parsed:
    out = Parsed()
    at = lambda i: text.count("\n", 0, i) + 1
    for m in re.finditer(r"<([A-Za-z][\w-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", text):
        tag, attrs = m.group(1), dict((k.lower(), v) for k, _, v in re.findall(r"([\w:-]+)\s*=\s*([\"'])(.*?)\2", m.group(2)))
        here = (at(m.start()), at(m.end()), _squash(m.group(0)))
        if "-" in tag:
            out.symbols.append((tag, "class", *here))
        if attrs.get("id"):
            out.symbols.append((attrs["id"], "struct", *here))
        if tag.lower() == "link" and attrs.get("href"):
            out.structure.append((MODULE, attrs["href"], "IMPORTS"))
        if tag.lower() == "script" and attrs.get("src"):
            out.structure.append((MODULE, attrs["src"], "IMPORTS"))
    return out


def css(text: str) -> Parsed:
    out = Parsed()
    kept, _ = blank(text, ("/* */",))
    at = lambda i: text.count("\n", 0, i) + 1
    for m in re.finditer(r"@import\s+(?:url\(\s*)?@?([^@;)\s]+)", kept):
        out.structure.append((MODULE, m.group(1), "IMPORTS"))
    for m in re.finditer(r"([^{};]+)\{([^{}]*)\}", kept):
        lead, body = m.group(1).strip(), m.group(2)
        here = (at(m.start(1) + len(m.group(1)) - len(m.group(1).lstrip())), at(m.end() - 1), _squash(lead))
        names = [(n, "class" if p == "." else "struct") for p, n in re.findall(r"([.#])([A-Za-z_][\w-]*)", lead)]
        out.symbols.extend((n, k, *here) for n, k in dict.fromkeys(names))
        for v in re.finditer(r"(--[\w-]+)\s*:", body):
            out.symbols.append((v.group(1), "struct", at(m.start(2) + v.start()), at(m.start(2) + v.start()), v.group(1)))
        out.calls.extend((names[0][0] if names else MODULE, v, False) for v in re.findall(r"var\(\s*(--[\w-]+)", body))
    for m in re.finditer(r"@keyframes\s+([\w-]+)\s*\{", kept):
        out.symbols.append((m.group(1), "function", at(m.start()), at(_close(kept, m.start(), "braces")), f"@keyframes {m.group(1)}"))
    return out


def keys(text: str, lang: str) -> Parsed:
    """Every key of a configuration file, scoped by the keys above it."""
    out = Parsed()
    if lang == "Json":
        text_ = blank(text, ("//", "/* */"))[0].replace("@", '"') if "//" in text or "/*" in text else text
        try:
            data = json.loads(re.sub(r",(\s*[}\]])", r"\1", text_))
        except ValueError:
            return out
        cursor = 0

        def walk(v, scope):
            nonlocal cursor
            if isinstance(v, dict):
                for k, x in v.items():
                    hit = text.find(json.dumps(k, ensure_ascii=False), cursor)
                    cursor = max(cursor, hit)
                    n = text.count("\n", 0, max(hit, 0)) + 1
                    out.symbols.append(("::".join([*scope, k]), "struct", n, n, k))
                    if k in ("extends", "main") and isinstance(x, str):
                        out.structure.append(("::".join([*scope, k]), x, "IMPORTS"))
                    walk(x, [*scope, k])
            elif isinstance(v, list):
                for x in v:
                    walk(x, scope)

        walk(data, [])
        return out
    scope: list[tuple[int, str]] = []
    section: list[str] = []
    for n, raw in enumerate(text.split("\n"), 1):
        if not raw.strip() or raw.lstrip().startswith(("#", "!", ";")):
            continue
        if lang == "Toml" and (m := re.match(r"\s*\[+\s*([^\]]+?)\s*\]+", raw)):
            section = [x.strip().strip("\"'") for x in m.group(1).split(".")]
            out.symbols.append(("::".join(section), "struct", n, n, raw.strip()))
        elif lang == "Yaml" and (m := re.match(r"(\s*(?:-\s+)*)([\w.\"'/-]+)\s*:(?:\s+(.*))?$", raw)):
            depth = len(m.group(1))
            while scope and scope[-1][0] >= depth:
                scope.pop()
            key = m.group(2).strip("\"'")
            name = "::".join([*(s for _, s in scope), key])
            out.symbols.append((name, "struct", n, n, raw.strip()))
            if key in ("depends_on", "include_role", "extends") and m.group(3):
                out.structure.extend((name, x.strip(" \"'"), "IMPORTS") for x in m.group(3).strip("[] ").split(",") if x.strip())
            scope.append((depth, key))
        elif lang in ("Toml", "Properties") and (m := re.match(r"\s*(?:export\s+)?([\w.\"'/-]+)\s*[=:]\s*(.*)$", raw)):
            out.symbols.append(("::".join([*section, m.group(1).strip("\"'")]), "struct", n, n, raw.strip()))
    return out


def markdown(text: str) -> dict:
    """Tags, aliases, wiki links, headings and code spans of a note, each with the heading it stands under."""
    front = re.match(r"---\n(.*?)\n---\n?", text, re.S)
    meta = front.group(1) if front else ""
    listed = lambda k: [x.strip().strip("\"'") for m in re.finditer(rf"(?m)^{k}:\s*(?:\[(.*?)\]|([^\n\[]+))?((?:\n\s*-\s+[^\n]+)*)", meta) for x in [*(m.group(1) or m.group(2) or "").split(","), *re.findall(r"-\s+([^\n]+)", m.group(3) or "")] if x.strip()]
    out = {"tags": listed("tags"), "aliases": listed("aliases"), "links": [], "headings": [], "code_refs": []}
    section, fenced = "", False
    body = text[front.end() :] if front else text
    first = text[: front.end()].count("\n") if front else 0
    for n, line in enumerate(body.split("\n"), first + 1):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            section = m.group(2)
            out["headings"].append((section, len(m.group(1)), n))
        out["links"] += [(section, x.split("|")[0].split("#")[0].strip()) for x in re.findall(r"\[\[([^\]]+)\]\]", line)]
        out["code_refs"] += [(section, x) for x in re.findall(r"`([^`]+)`", line)]
        out["tags"] += [x for x in re.findall(r"(?<![\w&/])#([A-Za-z][\w/-]*)", re.sub(r"`[^`]*`|^#+\s", "", line))]
    out["tags"] = list(dict.fromkeys(out["tags"]))
    return out


MARKUP = ("Html", "Svelte", "Vue", "Astro", "Liquid", "Cfml")
CONFIG = ("Json", "Yaml", "Toml", "Properties")


def parse(lang: str | None, text: str) -> Parsed:
    """What a file of a language holds; nothing for an unknown language."""
    if lang == "Python":
        return python(text)
    if lang == "Sql":
        return sql(text)
    if lang == "Css":
        return css(text)
    if lang in MARKUP:
        return html(text)
    if lang in CONFIG:
        return keys(text, lang)
    return by_grammar(text, lang) if lang in GRAMMARS else Parsed()


# Route pilots

# How web frameworks of four languages declare a route.
ROUTES = {
    "Python": r"@(?P<app>\w+)\.(?P<how>route|get|post|put|delete|patch)\(\s*[\"'](?P<path>[^\"']+)[\"'](?P<more>[^)]*)\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<name>\w+)",
    "Rust": r"\.route\(\s*\"(?P<path>[^\"]+)\"\s*,\s*(?P<how>get|post|put|delete|patch)\(\s*(?:\w+::)*(?P<name>\w+)\s*\)",
    "Go": r"\b\w+\.(?P<how>GET|POST|PUT|DELETE|PATCH)\(\s*\"(?P<path>[^\"]+)\"\s*,\s*(?:\w+\.)?(?P<name>\w+)",
    "Java": r"@(?P<how>Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<path>[^\"]+)\"[^)]*\)\s*\n(?:\s*@[^\n]*\n)*[^\n(]*?\b(?P<name>\w+)\s*\(",
}


def routes(lang: str, text: str) -> list[tuple[str, str, int]]:
    """(route, handler, line) of a file."""
    out = []
    for m in re.finditer(ROUTES.get(lang, r"(?!)"), text):
        how = m.group("how").upper()
        if how == "ROUTE":
            listed = re.findall(r"methods\s*=\s*\[([^\]]*)\]", m.groupdict().get("more") or "")
            how = ",".join(re.findall(r"\w+", listed[0])) if listed else "GET"
        out.append((f"{how} {m.group('path')}", m.group("name"), text.count("\n", 0, m.start()) + 1))
    return out
