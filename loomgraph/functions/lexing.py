"""What of a source file is code: comments and literals blanked in place, brackets paired."""

from __future__ import annotations

import re

_STRING = r'"(?:\\.|[^"\\])*"?'
#: What may begin something that isn't code.
BEGINS = {
    "rust": re.compile(rf"//[^\n]*|/\*|\bb?r(#*)\"|b?{_STRING}|b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^\\'\n])'", re.S),
    "typescript": re.compile(rf"//[^\n]*|/\*|{_STRING}|'(?:\\.|[^'\\\n])*'?|`|[{{}}]|/", re.S),
    "ruby": re.compile(r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|#[^\n]*|'(?:\\.|[^'\\])*'?|\"|%[qQwWiI]?([(\[{<])|<<[~-]?([\"']?)([A-Za-z_]\w*)\2|[{}]|/", re.S | re.M),
}
#: Strings that hold code: the sign that ends them and the one that opens code.
HOLDS = {"`": re.compile(r"\\.|`|\$\{", re.S), '"': re.compile(r"\\.|\"|#\{", re.S)}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: After these a slash begins a pattern; elsewhere it divides.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};~]|\b(?:return|typeof|case|if|unless|when|while|until|and|or|not))\s*$")
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def blanked(text: str, lang: str) -> str:
    """The text with comments, strings, characters and patterns as blanks; line ends and offsets stay. Code inside of strings stays as well."""
    gaps: list[tuple[int, int]] = []
    held: list[tuple[str, int]] = []  # strings that are open around the code at hand, and the braces open in it
    begins, at, later = BEGINS[lang], 0, None

    def string(sign: str, start: int) -> int:
        """Blanks from start to the string's end or to code in it; where to go on."""
        for m in HOLDS[sign].finditer(text, start):
            if m[0] == sign:
                gaps.append((start, m.end()))
                return m.end()
            if m[0][-1] == "{" and m[0][0] != "\\":
                held.append((sign, 0))
                gaps.append((start, m.end()))
                return m.end()
        gaps.append((start, len(text)))
        return len(text)

    while (m := begins.search(text, at)) is not None:
        if later and m.start() >= later[0]:  # the lines of a here-document
            gaps.append(later)
            at, later = max(at, later[1]), None
            continue
        sign, end = m[0], m.end()
        if sign == "{" or sign == "}":
            if held and sign == "{":
                held[-1] = held[-1][0], held[-1][1] + 1
            elif held and held[-1][1]:
                held[-1] = held[-1][0], held[-1][1] - 1
            elif held:
                end = string(held.pop()[0], m.start())
        elif sign == "/*":
            depth = 1
            for c in re.compile(r"/\*|\*/").finditer(text, end):
                depth += -1 if c[0] == "*/" else 1 if lang == "rust" else 0
                if not depth:
                    break
            end = c.end() if not depth else len(text)
            gaps.append((m.start(), end))
        elif sign == "/":
            found = _PATTERN.match(text, m.start()) if _BEFORE_PATTERN.search(text, max(0, m.start() - 80), m.start()) else None
            if found:
                end = found.end()
                gaps.append((m.start(), end))
        elif sign == "`" or (sign == '"' and lang == "ruby"):
            end = string(sign, m.start() + 1)
        elif lang == "rust" and m[1] is not None:
            close = text.find('"' + m[1], end)
            end = len(text) if close < 0 else close + 1 + len(m[1])
            gaps.append((m.start(), end))
        elif lang == "ruby" and m[1]:
            close = text.find(PAIRS[m[1]], end)
            end = len(text) if close < 0 else close + 1
            gaps.append((m.start(), end))
        elif lang == "ruby" and m[3]:
            line = text.find("\n", end)
            close = re.compile(rf"^[ \t]*{m[3]}[ \t]*$", re.M).search(text, line + 1) if line >= 0 else None
            later = (line, close.end()) if close else None
        else:
            gaps.append((m.start(), end))
        at = max(end, at + 1)
    if later:
        gaps.append(later)
    out, at = [], 0
    for a, b in sorted(gaps):
        if b > at:
            out += text[at:max(a, at)], "\n".join(" " * len(line) for line in text[max(a, at) : b].split("\n"))
            at = b
    return "".join((*out, text[at:]))


def brackets(code: str) -> dict[int, int]:
    """Where each bracket closes; one that doesn't closes at the end."""
    out, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            open_.append(m.start())
        else:
            while open_:  # a closing bracket closes all that were opened since its own
                top = open_.pop()
                out[top] = m.start()
                if PAIRS[code[top]] == m[0]:
                    break
    return out | dict.fromkeys(open_, len(code) - 1)


_RUBY_WORD = re.compile(r"(?<![\w.:@$])(def|class|module|do|begin|if|unless|while|until|case|for|end)(?![\w?!:])")
_ENDLESS = re.compile(r"def\s+[\w.]+[?!]?\s*(?:\([^\n]*?\))?\s*=\s")


def ruby_ends(code: str) -> dict[int, int]:
    """Where the `end` of each opening word ends."""
    out, open_, looped = {}, [], -1
    for m in _RUBY_WORD.finditer(code):
        word, line = m[1], code.rfind("\n", 0, m.start()) + 1
        before = code[line : m.start()].rstrip()
        if word == "end":
            if open_:
                out[open_.pop()] = m.end()
        elif word in ("if", "unless", "while", "until") and before and not re.search(r"[=(,{\[|&;]$|\b(?:do|then|else|begin|return)$", before):
            continue  # it comes after what it governs
        elif word == "do" and looped == line or word == "def" and _ENDLESS.match(code, m.start()):
            continue
        else:
            open_.append(m.start())
            if word in ("while", "until", "for"):
                looped = line
    return out | dict.fromkeys(open_, len(code))
