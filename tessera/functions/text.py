"""Text expressions, Column to Column: lines, tokens, identifiers, paths, hashes, byte-safe cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for blank tests.
BLANK = r"(?U)^\s*$"
#: Tokens of so many characters, or more, don't count.
LONGEST = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines without their ends (\\n or \\r\\n); a final line end opens no further line, an empty text has none."""
    return let(F.split(text, "\r?\n"), lambda p: F.slice(p, 1, F.size(p) - F.when(F.element_at(p, -1) == "", 1).otherwise(0)))


def is_blank(text: Column) -> Column:
    return text.rlike(BLANK)


def tokens(text: Column, longest: int = LONGEST) -> Column:
    """Lower-cased runs of letters and digits of fewer than `longest` characters, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.char_length(t) < longest)


def space_tokens(text: Column) -> Column:
    """Lower-cased words between runs of white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def identifiers(line: Column) -> Column:
    """ASCII identifiers that stand alone: word runs are cut first, since engines differ in what \\b means beyond ASCII."""
    return F.filter(F.regexp_extract_all(line, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def root_key(root: Column) -> Column:
    """The first 16 hex digits of the root path's SHA-256: the partition of everything below that root."""
    return F.substring(F.sha2(root, 256), 1, 16)


def chunk_id(root: Column, path: Column, start: Column, end: Column, file_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", root, path, start, end, file_hash), 256)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null for a name without one, and for a dot file's only dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1), F.lit(""))


def relative_path(path: Column, root: Column) -> Column:
    inside = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(inside), F.substr(path, F.char_length(inside) + 1)).otherwise(path)


def control_ratio(text: Column) -> Column:
    """Share of bytes below 0x20 other than tab, line feed and carriage return; null for an empty text."""
    return F.try_divide(F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).cast("double"), F.octet_length(text).cast("double"))


def looks_like_text(text: Column, most: float = 0.3) -> Column:
    """Fewer control bytes than the given share; an empty file is not text."""
    return F.coalesce(control_ratio(text) < most, F.lit(False))


def cut_bytes(text: Column, most: int, marker: str = "") -> Column:
    """At most `most` UTF-8 bytes, cut between characters, and then the marker; shorter texts stay as they are."""
    raw = F.encode(text, "UTF-8")
    inner = lambda k: F.hex(F.substring(raw, most + 1 - k, 1)).rlike("^[89AB]")  # noqa: E731  a byte inside a character
    keep = F.when(~inner(0), most).when(~inner(1), most - 1).when(~inner(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), keep), "UTF-8"), F.lit(marker)))


def first_line(text: Column) -> Column:
    return F.coalesce(F.get(lines(text), F.lit(0)), F.lit(""))


def signature(text: Column, most: int = 200) -> Column:
    """The first line of a definition, trimmed, cut to 200 bytes and `...`."""
    return cut_bytes(F.trim(first_line(text)), most, "...")
