"""Globs and substring patterns over paths, compiled on the driver into regular expressions that run in the scan's stage."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadGlob(ValueError):
    pass


def glob_regex(glob: str) -> str:
    """Java and Python regex of a glob: `*` and `?` cross slashes, `**/` may be nothing, `[..]` and `{a,b}` as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob[i:] == "**" and i and glob[i - 1] == "/":
            out.append(".+")
            break
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise BadGlob(f"unclosed class in {glob!r}")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append(re.escape(c) if not c.isalnum() and ord(c) < 128 and c not in "/_-" else c)
        i += 1
    if depth:
        raise BadGlob(f"unclosed group in {glob!r}")
    return "".join(out)


def path_regex(glob: str) -> str:
    """The whole path, the path without its leading slash, or, if the glob has a star, any part of it after a slash."""
    return r"(?s)^(?:.*/)?(?:" + glob_regex(glob) + r")$" if "*" in glob else r"(?s)^/?(?:" + glob_regex(glob) + r")$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether any glob fits; a glob that can't be read is a substring; no globs fit everything."""
    if not globs:
        return F.lit(True)
    tests = []
    for g in globs:
        try:
            tests.append(path.rlike(path_regex(g)))
        except BadGlob:
            tests.append(path.contains(g))
    return reduce(Column.__or__, tests)


def included(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any include pattern and no exclude pattern; a pattern with a wildcard is a glob, any other a substring of the path."""

    def hit(p: str) -> Column:
        return matches_any(path, [p]) if any(c in p for c in "*?[") else path.contains(p)

    yes = reduce(Column.__or__, map(hit, include)) if include else F.lit(True)
    no = reduce(Column.__or__, map(hit, exclude)) if exclude else F.lit(False)
    return yes & ~no
