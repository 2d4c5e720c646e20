"""Ignore files: nested .gitignore and .ignore with precedence, negation and directory rules, and the repository's excludes."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

NAMES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    base: str
    regex: re.Pattern
    negated: bool
    directories_only: bool


def _regex(glob: str, anchored: bool) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob[i:] == "**":
            out.append(".*")
            break
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append(re.escape(c))
        i += 1
    return ("" if anchored else "(?:.*/)?") + "".join(out)


def parse(text: str, base: str) -> list[Rule]:
    """Rules of one ignore file; base: its folder, relative to the scanned root, with a trailing slash unless empty."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        directories_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        try:
            rules.append(Rule(base, re.compile(_regex(line.lstrip("/"), anchored), re.S), negated, directories_only))
        except re.error:
            continue
    return rules


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that fits ignores path (relative to the root). Parents are taken to be tested already."""
    for r in reversed(rules):
        if path.startswith(r.base) and (is_dir or not r.directories_only) and r.regex.fullmatch(path[len(r.base) :]):
            return not r.negated
    return False


def _read(path: Path, base: str) -> list[Rule]:
    try:
        return parse(path.read_text(errors="replace"), base)
    except OSError:
        return []


def walk(root: str, user_excludes: str | None = "~/.config/git/ignore"):
    """(relative path, size) of every file under root that no rule ignores; hidden files are included, .git folders never."""
    top = Path(root)
    rules = _read(Path(user_excludes).expanduser(), "") if user_excludes else []
    rules += _read(top / ".git" / "info" / "exclude", "")

    def visit(folder: Path, base: str, rules: list[Rule]):
        rules = [*rules, *(r for name in NAMES for r in _read(folder / name, base))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = base + e.name
            if e.name == ".git" or e.is_symlink():
                continue
            if e.is_dir():
                if not ignored(path, True, rules):
                    yield from visit(Path(e.path), path + "/", rules)
            elif e.is_file() and not ignored(path, False, rules):
                try:
                    yield path, e.stat().st_size
                except OSError:
                    yield path, 0

    yield from visit(top, "", rules)
