"""Symbols, imports and calls of source files, by Python's own parser or a scan of blanked code, Arrow-batched."""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lexing import blanked, brackets, ruby_ends
from loomgraph.functions.text import module_path

SCHEMA = "id string, what string, kind string, name string, fqn string, start_line int, end_line int, target string, signature string, hash string, confidence double, evidence string"
#: How sure an import and a call are of what they name; characters of a signature and of evidence.
IMPORT, CALL, SIGNATURE, EVIDENCE = 1.0, 0.8, 500, 200
#: How the languages name kinds of symbols.
KINDS = {"fn": "function", "struct": "class", "enum": "enum", "trait": "interface", "mod": "module", "type": "type", "const": "constant", "static": "constant", "function": "function", "class": "class", "interface": "interface", "def": "function", "module": "module"}
DECLARES = {
    "rust": re.compile(r"(?:\bpub\b(?:\s*\([^)]*\))?\s+)?(?:\b(?:default|async|unsafe|const|extern)\s+)*\b(fn|struct|enum|trait|mod|type|const|static)\s+(?:mut\s+)?([A-Za-z_]\w*)"),
    "typescript": re.compile(r"(?<![\w$.])(?:(?:async\s+)?(function)\s*\*?|(?:abstract\s+)?(class|interface|type|enum))\s+([A-Za-z_$][\w$]*)"),
    "ruby": re.compile(r"(?<![\w.:@$])(def|class|module)\s+(?:self\.|[A-Z]\w*\.)?((?:[A-Z]\w*::)*[A-Za-z_]\w*[?!]?)"),
}
_FUNCTION_VALUE = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;{}]*)?=\s*(?:async\s*)?(?:function\b|(?:\((?:[^()]|\([^()]*\))*\)\s*(?::[^=;{}]*)?|[A-Za-z_$][\w$]*\s*)=>)")
_METHOD = re.compile(r"(?:\b(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?([A-Za-z_$#][\w$]*)\s*(?:<[^<>(){}]*>)?\(")
_CALLS = {
    "rust": re.compile(r"([A-Za-z_]\w*)\s*(?:::\s*<[^<>()]*>\s*)?\("),
    "typescript": re.compile(r"([A-Za-z_$][\w$]*)\s*(?:<[^<>(){};]*>\s*)?(?:\?\.)?\("),
    "ruby": re.compile(r"([A-Za-z_]\w*[?!]?)\(|(?<=[\w)\]}])\s*&?\.\s*([a-z_]\w*[?!]?)|(?:^|(?<=[;{|=]))[ \t]*([a-z_]\w*[?!]?)(?=[ \t]+\S)", re.M),
}
IMPORTS = {
    "rust": re.compile(r"(?:\bpub\b(?:\s*\([^)]*\))?\s+)?\buse\s+([^;{,]+)[^;]*;"),
    "typescript": re.compile(r"^[ \t]*import\b[^;\"'`(]*(?=[\"'])", re.M),
    "ruby": re.compile(r"(?<![\w.])(?:require_relative|require|load|autoload)\b[ \t(]*(?=[\"'])"),
}
_QUOTED = re.compile(r"([\"'])(.*?)\1")
_WORDS = {
    "rust": frozenset("if while match for return fn in loop move as let where impl dyn pub use else unsafe async await ref mut struct enum trait mod type const static".split()),
    "typescript": frozenset("if for while switch catch function return typeof super import new await async yield of in do else delete void".split()),
    "ruby": frozenset("if unless while until case when def class module return and or not do end else elsif then begin rescue ensure yield super alias undef in require require_relative load autoload".split()),
}


class _Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)


def _hash(piece: str) -> str:
    return hashlib.sha256(piece.encode("utf-8", "surrogatepass")).hexdigest()


def _symbol(kind: str, name: str, fqn: str, first: int, last: int, whole: str, head: str) -> tuple:
    return "symbol", kind, name, fqn, first, last, None, head[:SIGNATURE].strip() or None, _hash(whole), None, None


def _candidate(what: str, owner: str | None, line: int, target: str, evidence: str) -> tuple:
    return what, None, None, owner, line, line, target, None, None, IMPORT if what == "import" else CALL, evidence[:EVIDENCE]


def _python(text: str, module: str) -> list[tuple]:
    out: list[tuple] = []
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    at = lambda line, byte: starts[line - 1] + (byte if lines[line - 1].isascii() else len(lines[line - 1].encode()[:byte].decode("utf-8", "ignore")))
    piece = lambda n: text[at(n.lineno, n.col_offset) : at(n.end_lineno, n.end_col_offset)]

    def walk(node: ast.AST, scope: tuple[str, ...], owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, own = scope, owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                own = "::".join(filter(None, (module, *scope, child.name)))
                first = at(child.lineno, child.col_offset)
                body = min(at(child.body[0].lineno, child.body[0].col_offset), *(at(d.lineno, d.col_offset) for d in getattr(child.body[0], "decorator_list", [])[:1]), len(text))
                out.append(_symbol("class" if isinstance(child, ast.ClassDef) else "function", child.name, own, child.lineno, child.end_lineno, piece(child), text[first:body]))
                inner = (*scope, child.name)
            elif isinstance(child, ast.Import):
                out.extend(_candidate("import", None, child.lineno, a.name, piece(child)) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(_candidate("import", None, child.lineno, "." * child.level + (child.module or ""), piece(child)))
            elif isinstance(child, ast.Call) and owner:
                name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
                if name:
                    out.append(_candidate("call", owner, child.lineno, name, piece(child)))
            walk(child, inner, own)

    try:
        walk(ast.parse(text), (), None)
    except (SyntaxError, ValueError, RecursionError):
        pass
    return out


def _declared(code: str, lang: str, close: dict[int, int]) -> Iterator[tuple[int, int, int, str, str, int]]:
    """(start, end, end of the head, kind, name, where the name begins) of each declaration."""

    def body(at: int) -> tuple[int, int]:
        """End of the declaration and of its head, from an offset behind the name."""
        while at < len(code):
            c = code[at]
            if c == "{":
                return close[at] + 1, at
            if c == ";" or c == "}":
                return at + (c == ";"), at
            at = close[at] + 1 if c in "([" else at + 1
        return len(code), len(code)

    last = lambda at: code[max(0, at - 4096) : at].rstrip()[-1:]
    for m in DECLARES[lang].finditer(code):
        kind, name = (g for g in m.groups() if g)
        if lang == "rust" and last(m.start()) not in ("", "{", "}", ";", "]"):
            continue
        if lang == "typescript" and (kind == "type" and not re.match(r"\s*(?:<[^;{}]*?>)?\s*=", code[m.end() : m.end() + 400]) or kind == "function" and last(m.start()) in ("=", "(", ",", ":", "?")):
            continue
        if lang == "ruby":
            end = close.get(m.start(1), code.find("\n", m.end()) if code.find("\n", m.end()) >= 0 else len(code))
            line = code.find("\n", m.end())
            yield m.start(), end, min(end, line if line >= 0 else end), KINDS[kind], name, m.start(2)
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end, head = body(m.end())
        yield start, end, head, KINDS[kind], name, m.start(m.lastindex)
    if lang != "typescript":
        return
    for m in _FUNCTION_VALUE.finditer(code):
        arrow = m[0].endswith("=>")
        rest = re.match(r"\s*", code[m.end() : m.end() + 400]).end() + m.end()
        end, head = body(rest) if not arrow or code[rest : rest + 1] == "{" else (re.compile(r"[;\n]|\Z").search(code, close.get(rest, rest)).start(), m.end())
        yield m.start(1), end, head, "function", m[1], m.start(1)
    for m in _METHOD.finditer(code):
        after = close[m.end() - 1] + 1
        opens = re.compile(r"\s*(?::[^;{}=]*)?\{").match(code, after)
        if opens and m[1] not in _WORDS[lang] and last(m.start()) in ("{", "}", ";", ","):
            yield m.start(), close[opens.end() - 1] + 1, opens.end() - 1, "function", m[1], m.start(1)


def _scanned(text: str, module: str, lang: str) -> list[tuple]:
    """Declarations by their extent in blanked code; what encloses what gives scopes and the callers of calls."""
    code, lines, out = blanked(text, lang), _Lines(text), []
    close = brackets(code)
    found = sorted(set(_declared(code, lang, ruby_ends(code) if lang == "ruby" else close)), key=lambda d: (d[0], -d[1]))
    names, events = {d[5] for d in found}, []
    for m in IMPORTS[lang].finditer(code if lang == "rust" else text):
        if lang != "rust":
            quoted = _QUOTED.match(text, m.end())
            if not quoted or not code[m.start() : m.end()].strip():
                continue
        target = re.sub(r"\s+|::\s*$", "", m[1]) if lang == "rust" else quoted[2]
        if target:
            events.append((m.start(), 0, _candidate("import", None, lines.of(m.start()), target, text[m.start() : m.end() if lang == "rust" else quoted.end()].strip())))
    for m in _CALLS[lang].finditer(code):
        name, at = m[m.lastindex], m.start(m.lastindex)
        if name in _WORDS[lang] or at in names or re.search(r"\bnew\s+(?:[\w$]+\.)*$", code[max(0, at - 60) : at]):
            continue
        if lang == "ruby" and m.lastindex == 3:  # a name and its arguments, not an operator or an assignment
            rest = text[m.end() : m.end() + 40].lstrip(" \t")
            if not re.match(r"[A-Za-z_\"':@\[{0-9&*]", rest) or re.match(r"(?:if|unless|while|until|and|or|do|then|in|rescue)\b|[&*] ", rest):
                continue
        opens = m.end() - 1
        evidence = text[at : close.get(opens, opens) + 1] if code[opens] == "(" else text[at : m.end()]
        events.append((at, 1, (name, lines.of(at), evidence)))
    stack: list[tuple[int, str, str]] = []  # end, name and fqn of the declarations around
    for at, order, what in sorted([*((d[0], -1, d) for d in found), *events], key=lambda e: e[:2]):
        while stack and stack[-1][0] <= at:
            stack.pop()
        if order < 0:
            start, end, head, kind, name, _ = what
            fqn = "::".join(filter(None, (module, *(n for _, n, _ in stack), name)))
            out.append(_symbol(kind, name, fqn, lines.of(start), lines.of(max(start, end - 1)), text[start:end], text[start:head]))
            stack.append((end, name, fqn))
        elif order == 0:
            out.append(what)
        elif stack:
            out.append(_candidate("call", stack[-1][2], what[1], re.split(r"[.:]", what[0])[-1], what[2]))
    return out


def parse(text: str, module: str, lang: str) -> list[tuple]:
    """(what, kind, name, fqn, start_line, end_line, target, signature, hash, confidence, evidence) of one file's symbols, imports and calls."""
    return _python(text, module) if lang == "python" else _scanned(text, module, lang)


def symbols(files: DataFrame) -> DataFrame:
    """files(id, language, content, and path if it isn't the id) -> a row for each symbol, import and call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, m, lang, c in zip(b["id"], b["module"], b["language"], b["content"], strict=True) for r in parse(bytes(c or b"").decode("utf-8", "replace"), m, lang)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("id", "language", module_path(F.col("path" if "path" in files.columns else "id")).alias("module"), "content").mapInPandas(run, SCHEMA)
