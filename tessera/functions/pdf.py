"""Markdown from the plain text of a PDF: tables and headings by the look of their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lines

#: White space as Unicode has it: what (?U)\\s matches, as a set of characters to trim.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _columns(line: Column) -> Column:
    """Cells between tabs, if there are any, else between two blanks; of the latter, empty ones don't count."""
    apart = F.filter(F.split(line, "  "), lambda c: F.trim(c) != "")
    return F.transform(F.when(line.contains("\t"), F.split(line, "\t")).otherwise(apart), lambda c: F.trim(c))


def is_table_row(line: Column) -> Column:
    """Three words at least, and a tab or two blanks in a row."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda c: c != "")
    return (line.contains("\t") | line.contains("  ")) & (F.size(words) >= 3)  # the cheap test first


def table_row(line: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(_columns(line), " | "), F.lit(" |"))


def table_separator(line: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(_columns(line), lambda c: F.lit("---")), " | "), F.lit(" |"))


def is_heading(line: Column) -> Column:
    """Mostly capitals and under 100 bytes; or a short line that ends with a colon and is no address."""
    upper = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    letters = F.char_length(F.regexp_replace(line, r"[^\p{L}]", ""))
    size = F.octet_length(line)
    capitals = (size < 100) & (letters > 0) & (upper > 0.8 * letters)  # only short lines have their letters counted
    return capitals | (line.endswith(":") & (size < 80) & ~line.contains("://"))


def heading(line: Column) -> Column:
    return F.concat(F.when(F.octet_length(line) < 30, "## ").otherwise("### "), F.regexp_replace(line, ":+$", ""))


def markdown(text: Column) -> Column:
    """The whole text, line by line: a table's first row gets a separator below it, headings get their level and a blank line."""

    def part(line: Column, table: Column, was: Column) -> Column:
        leave = F.when(was & ~table, "\n").otherwise("")
        row = F.when(was, table_row(line)).otherwise(F.concat_ws("\n", table_row(line), table_separator(line)))
        made = F.when(line == "", "").when(table, row).when(is_heading(line), F.concat(heading(line), F.lit("\n"))).otherwise(line)
        return F.concat(leave, made, F.lit("\n"))

    def joined(rows: Column, tables: Column) -> Column:
        was = lambda i: F.coalesce(F.get(tables, i - 1), F.lit(False))
        return F.array_join(F.transform(rows, lambda line, i: part(line, F.get(tables, i), was(i))), "")

    # each line is trimmed and tested once, and the parts are joined once: a text that grows by every line is copied by every line
    trimmed = F.transform(lines(text), lambda raw: F.trim(raw, F.lit(SPACE)))
    return let(trimmed, lambda rows: let(F.transform(rows, lambda line: (line != "") & is_table_row(line)), lambda tables: joined(rows, tables)))
