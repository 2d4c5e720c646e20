"""Structural units and definitions of source code, by scanning: no grammar library is at hand.

Python is parsed by the standard library. For the other languages, comments and strings are blanked out first; then
declarations are found by patterns and their ends by matching braces (or `end` for Ruby). Units come in the order they
start, outer before inner. Odd code may give other units than a full grammar would: precision `medium` for Python, `low`
for the rest.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.language import GRAMMARS, KIND_OF_NODE


@dataclass(frozen=True)
class Unit:
    node: str
    name: str | None
    start_line: int
    end_line: int
    start_col: int
    end_col: int
    parent: int  # number of the enclosing unit, or -1
    doc: str | None = None


def _names(*words: str) -> str:
    return "|".join(words)


_ID = r"[A-Za-z_$][\w$]*"
#: grammar -> (node kind, pattern with a group `n` for the name). The declaration ends with its braces, or with `;`.
_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function_item", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<n>{_ID})"),
        ("impl_item", rf"(?:unsafe\s+)?impl\b(?:\s*<[^{{;]*?>)?\s+(?:[^{{;]*?\bfor\s+)?(?P<n>{_ID}(?:::{_ID})*)"),
        ("trait_item", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>{_ID})"),
        ("struct_item", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>{_ID})"),
        ("enum_item", rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>{_ID})"),
        ("mod_item", rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>{_ID})"),
        ("const_item", rf"(?:pub(?:\([^)]*\))?\s+)?const\s+(?P<n>{_ID})\s*:"),
        ("static_item", rf"(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<n>{_ID})\s*:"),
        ("type_item", rf"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>{_ID})"),
    ],
    "javascript": [
        ("function_declaration", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<n>{_ID})"),
        ("function_expression", rf"(?:const|let|var)\s+(?P<n>{_ID})\s*=\s*(?:async\s+)?function\b"),
        ("arrow_function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=;{{]+)?=>"),
        ("class_declaration", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_ID})"),
        ("method_definition", rf"(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<n>#?{_ID})\s*(?:<[^<>(){{}}]*>)?\([^(){{}};]*\)\s*(?::[^={{;]+)?(?=\{{)"),
    ],
    "go": [
        ("function_declaration", rf"func\s+(?P<n>{_ID})"),
        ("method_declaration", rf"func\s*\([^)]*\)\s*(?P<n>{_ID})"),
        ("type_declaration", rf"type\s+(?P<n>{_ID})"),
    ],
    "java": [
        ("class_declaration", rf"(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(?P<n>{_ID})"),
        ("interface_declaration", rf"(?:(?:public|private|protected|static|abstract|sealed)\s+)*@?interface\s+(?P<n>{_ID})"),
        ("enum_declaration", rf"(?:(?:public|private|protected|static)\s+)*enum\s+(?P<n>{_ID})"),
        ("method_declaration", rf"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^<>]*>\s*)?{_ID}[\w.<>\[\], ?]*\s+(?P<n>{_ID})\s*\([^(){{}};]*\)\s*(?:throws\s+[\w., ]+)?(?=[{{;])"),
        ("constructor_declaration", rf"(?:(?:public|private|protected)\s+)?(?P<n>[A-Z][\w$]*)\s*\([^(){{}};]*\)\s*(?:throws\s+[\w., ]+)?(?=\{{)"),
    ],
    "swift": [
        ("function_declaration", rf"(?:(?:public|private|internal|fileprivate|open|static|override|mutating|final|class)\s+)*func\s+(?P<n>{_ID})"),
        ("class_declaration", rf"(?:(?:public|private|internal|open|final)\s+)*(?:class|actor|extension)\s+(?P<n>{_ID})"),
        ("struct_declaration", rf"(?:(?:public|private|internal)\s+)*struct\s+(?P<n>{_ID})"),
        ("enum_declaration", rf"(?:(?:public|private|internal|indirect)\s+)*enum\s+(?P<n>{_ID})"),
        ("protocol_declaration", rf"(?:(?:public|private|internal)\s+)*protocol\s+(?P<n>{_ID})"),
        ("init_declaration", r"(?:(?:public|private|internal|convenience|required)\s+)*(?P<n>init|deinit|subscript)\b[?!]?\s*(?=[({<])"),
    ],
    "c": [
        ("struct_specifier", rf"(?:typedef\s+)?struct\s+(?P<n>{_ID})\s*(?=\{{)"),
        ("enum_specifier", rf"(?:typedef\s+)?enum\s+(?P<n>{_ID})\s*(?=\{{)"),
        ("union_specifier", rf"(?:typedef\s+)?union\s+(?P<n>{_ID})\s*(?=\{{)"),
        ("function_definition", rf"(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?P<n>{_ID}(?:::~?{_ID})*)\s*\([^(){{}};]*\)\s*(?:const|noexcept|override|final|\s)*(?=\{{)"),
    ],
    "ruby": [
        ("class", r"class\s+(?P<n>[A-Z][\w:]*)"),
        ("module", r"module\s+(?P<n>[A-Z][\w:]*)"),
        ("singleton_method", r"def\s+(?:self|[A-Z]\w*)\.(?P<n>[\w?!=]+)"),
        ("method", r"def\s+(?P<n>(?!self\.)[\w?!=]+)(?!\.)"),
    ],
    "php": [
        ("function_definition", rf"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<n>{_ID})"),
        ("class_declaration", rf"(?:(?:final|abstract|readonly)\s+)*class\s+(?P<n>{_ID})"),
        ("interface_declaration", rf"interface\s+(?P<n>{_ID})"),
        ("trait_declaration", rf"trait\s+(?P<n>{_ID})"),
        ("namespace_definition", rf"namespace\s+(?P<n>{_ID}(?:\\{_ID})*)"),
    ],
}
_PATTERNS["typescript"] = [*_PATTERNS["javascript"], ("interface_declaration", rf"(?:export\s+)?interface\s+(?P<n>{_ID})"), ("type_alias_declaration", rf"(?:export\s+)?type\s+(?P<n>{_ID})[^=;]*="), ("enum_declaration", rf"(?:export\s+)?(?:const\s+)?enum\s+(?P<n>{_ID})")]
_PATTERNS["cpp"] = [*_PATTERNS["c"], ("class_specifier", rf"(?:template\s*<[^;{{]*>\s*)?class\s+(?P<n>{_ID})[^;{{()]*(?=\{{)"), ("namespace_definition", rf"namespace\s+(?P<n>{_ID}(?:::{_ID})*)\s*(?=\{{)")]
_PATTERNS["csharp"] = [
    ("namespace_declaration", rf"namespace\s+(?P<n>{_ID}(?:\.{_ID})*)"),
    ("struct_declaration", rf"(?:(?:public|private|protected|internal|readonly)\s+)*struct\s+(?P<n>{_ID})"),
    *((k, p.replace("public|private|protected", "public|private|protected|internal|virtual|override|async|partial")) for k, p in _PATTERNS["java"]),
]
_KEYWORDS = frozenset("if else for while switch catch return do try with new throw match loop function await yield sizeof delete case default when using lock foreach unless until synchronized".split())
#: Kinds whose patterns start with no keyword, so calls and statements may look like them; what can't stand before one.
_BARE = frozenset({"method_definition", "method_declaration", "constructor_declaration", "function_definition"})
_NO_METHOD = re.compile(r"(?:\b(?:function|new|return|func|fn|def|class)\b\s*\*?|[=.])\s*\Z")
_COMPILED = {g: [(k, re.compile(r"(?<![\w$.#])" + p)) for k, p in ps] for g, ps in _PATTERNS.items()}
#: Kinds that make chunks but no definitions, and the other way round.
_CHUNK_ONLY = frozenset({"namespace_definition:php", "namespace_declaration", "union_specifier", "init_declaration"})
_DEFINITION_ONLY = frozenset({"const_item", "static_item", "type_item", "interface_declaration:typescript", "type_alias_declaration", "enum_declaration:java", "enum_declaration:typescript"})
_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n]){1,2}'|`(?:\\.|[^`\\])*`", re.S)
_BLANK_HASH = re.compile(r"#[^\n]*|=begin.*?=end|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)


def _blanked(text: str, grammar: str) -> str:
    """text with comments and strings as blanks, all places kept."""
    pattern = _BLANK_HASH if grammar == "ruby" else _BLANK
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _python(text: str) -> list[Unit]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Unit] = []
    rows = text.split("\n")
    doc = lambda node, line: _comment_above(rows, line) or ast.get_docstring(node)

    def visit(node: ast.AST, parent: int) -> None:
        for child in ast.iter_child_nodes(node):
            at = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                if child.decorator_list:
                    first = child.decorator_list[0]
                    out.append(Unit("decorated_definition", child.name, first.lineno, child.end_lineno, max(0, first.col_offset - 1), child.end_col_offset, at, doc(child, first.lineno)))
                    at = len(out) - 1
                out.append(Unit(kind, child.name, child.lineno, child.end_lineno, child.col_offset, child.end_col_offset, at, doc(child, child.lineno)))
                at = len(out) - 1
            visit(child, at)

    visit(tree, -1)
    return out


def _matching(text: str, at: int) -> int:
    """Place of the brace that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


_RUBY = re.compile(r"(?m)(?:^|(?<=;)|(?<== )|(?<==))[ \t]*(class|module|def|if|unless|while|until|case|begin|for)\b|\b(do)\b|\b(end)\b")


def _ruby_end(text: str, at: int) -> int:
    depth = 0
    for m in _RUBY.finditer(text, at):
        depth += -1 if m[3] else 1
        if not depth:
            return m.end() - 1
    return -1


def _end(text: str, grammar: str, m: re.Match) -> int:
    """Last place of a declaration, or -1 if it isn't one."""
    if grammar == "ruby":
        return _ruby_end(text, text.rfind("\n", 0, m.start()) + 1)
    stop = re.compile(r"[{;]|\n\s*\n" if grammar != "go" else r"[{;\n]").search(text, m.end())
    if not stop:
        return len(text) - 1 if grammar == "go" else -1
    if stop[0] == "{":
        return _matching(text, stop.start())
    return stop.start() if stop[0] == ";" or grammar == "go" else -1


def _comment_above(lines: list[str], line: int) -> str | None:
    """The comment that ends right above a line (attributes and decorators between don't count), without its marks."""
    k = line - 2
    while k >= 0 and re.match(r"\s*(#\[|@)", lines[k]):
        k -= 1
    got: list[str] = []
    while k >= 0 and re.match(r"\s*(///?|/\*|\*|#(?!\[))", lines[k]):
        got.insert(0, re.sub(r"^\s*(///?!?|/\*+|\*+/|\*|#)\s?|\s*\*+/\s*$", "", lines[k]).strip())
        k -= 1
    return "\n".join(got).strip() or None


def units(ext: str | None, text: str) -> list[Unit]:
    """All units of a file by its extension; none if it has no grammar or can't be read."""
    grammar = GRAMMARS.get((ext or "").lower())
    if grammar is None:
        return []
    if grammar == "python":
        return _python(text)
    clean, found, named = _blanked(text, grammar), {}, set()
    for kind, pattern in _COMPILED[grammar]:
        for m in pattern.finditer(clean):
            name = m["n"]
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if start in found or m.start("n") in named or (kind in _BARE and grammar not in ("php", "go") and (name in _KEYWORDS or m[0].split(None, 1)[0] in _KEYWORDS or _NO_METHOD.search(clean, max(0, start - 20), start))):
                continue
            end = _end(clean, grammar, m)
            if end >= 0:
                found[start] = (end, kind, name)
                named.add(m.start("n"))
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    from bisect import bisect_left

    at = lambda i: (bisect_left(breaks, i) + 1, i - (breaks[b - 1] + 1 if (b := bisect_left(breaks, i)) else 0))
    rows, out, stack = text.split("\n"), [], []
    for start in sorted(found, key=lambda s: (s, -found[s][0])):
        end, kind, name = found[start]
        while stack and stack[-1][0] < start:
            stack.pop()
        (a, b), (c, d) = at(start), at(end)
        out.append(Unit(kind, name, a, c, b, d + 1, stack[-1][1] if stack else -1, _comment_above(rows, a)))
        stack.append((end, len(out) - 1))
    return out


def _is(unit: Unit, kinds: frozenset[str], grammar: str) -> bool:
    return unit.node in kinds or f"{unit.node}:{grammar}" in kinds


def chunk_units(ext: str | None, text: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line) of the units that make chunks."""
    grammar = GRAMMARS.get((ext or "").lower(), "")
    return [(u.node, u.start_line, u.end_line) for u in units(ext, text) if not _is(u, _DEFINITION_ONLY, grammar)]


def definitions(ext: str | None, text: str) -> Iterator[tuple[int, int, Unit]]:
    """(number, number of the enclosing definition or -1, unit) of the units that define a name."""
    grammar = GRAMMARS.get((ext or "").lower(), "")
    every = units(ext, text)
    good = [bool(u.name) and not _is(u, _CHUNK_ONLY, grammar) for u in every]
    for i, u in enumerate(every):
        if good[i]:
            p = u.parent
            while p >= 0 and not good[p]:
                p = every[p].parent
            yield i, p, u


def kind_of(unit: Unit) -> str:
    return KIND_OF_NODE.get(unit.node, "unknown")
