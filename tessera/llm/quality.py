"""Quality rules as a short-circuit cascade (native: DataFrame functions only).

Every rule is a Column predicate over a text's facts. Their conjunction decides, so the order is free; it is chosen on a
sample as rejections per second of evaluation, cheapest rejection first, and written as one CASE whose later branches
Spark evaluates only for rows that the earlier ones let pass. A rule's seconds are those of the fastest of REPEATS jobs
over the cached sample, less those of the fastest job that evaluates nothing, so that scheduling doesn't count.

Edge cases: null text counts as empty; an empty text has no words and fails `few_words`; texts of any length are read
whole; rules that reject as much per second keep their order; repeated rows are judged one by one; an empty table gives an
empty result (the default order is used); extra columns, whatever their names, are carried along by filter_quality() and
not read by measure().
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = "[#*$%&|<>]"
#: Rows that the order of the rules is estimated on; the verdicts never depend on it.
SAMPLE_ROWS, REPEATS = 2000, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, and only where the whole is evaluated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_words(ws: Column) -> Column:
    return F.size(ws).cast("long")


def word_chars(ws: Column) -> Column:
    return F.char_length(F.array_join(ws, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def line_counts(text: Column) -> Column:
    """struct<n, dup>: lines with a word, and those that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\u000b\f\r"))) > 0)
    return let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))


def n_repeat_words(ws: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text.

    Windows are compared by a 64-bit hash; equal ones become neighbours by one sort, so the cost is n log n for any
    number of repeats and never the square of a frequent window's count.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    windows = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
    return let(F.sort_array(windows), repeated)


def _letters_shouted(text: Column) -> Column:
    upper, lower = (F.regexp_count(text, F.lit(f"[{a}]")) for a in ("\\p{Lu}", "\\p{Ll}"))
    return upper > lower


class Facts(NamedTuple):
    """What rules may ask of a text; each is evaluated only where a rule asks for it."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    lines: Column
    n_repeat_words: Column

    @staticmethod
    def of(text: Column, ws: Column) -> Facts:
        return Facts(text, ws, n_words(ws), word_chars(ws), n_symbols(text), line_counts(text), n_repeat_words(ws))


class Rule(NamedTuple):
    """name, and the predicate over a text's facts that rejects."""

    name: str
    fails: Callable[[Facts], Column]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 2 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: let(f.lines, lambda x: 2 * x["dup"] > x["n"])),
    Rule("long_words", lambda f: f.word_chars > 40 * f.n_words),
    Rule("shouting", lambda f: _letters_shouted(f.text)),
)


def verdict(rules: Sequence[Rule], facts: Facts) -> Column:
    """Name of the first rule, in the order given, that rejects; null if none does."""
    out: Column | None = None
    for r in rules:
        hit = F.coalesce(r.fails(facts), F.lit(False))
        out = F.when(hit, r.name) if out is None else out.when(hit, r.name)
    return F.lit(None).cast("string") if out is None else out


def order_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Rule]:
    """Rules by rejections per second on a sample of at most sample_rows rows. Ties and rules that reject nothing keep their order."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).sample(min(1.0, 1.2 * sample_rows / total), seed).limit(sample_rows)
    sample = sample.select("t", words(F.col("t")).alias("w")).persist()

    def timed(test: Column) -> tuple[int, float]:
        query, best = sample.agg(F.count_if(test)), float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            rejected = query.head()[0]
            best = min(best, time.perf_counter() - began)
        return rejected, best

    try:
        sample.count()
        facts = Facts.of(F.col("t"), F.col("w"))
        _, nothing = timed(F.size("w") < 0)
        rate = {}
        for r in rules:
            rejected, seconds = timed(F.coalesce(r.fails(facts), F.lit(False)))
            rate[r.name] = rejected / max(seconds - nothing, 1e-4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -rate[r.name])


def filter_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ordered = order_rules(docs, text, rules)
    # bound by let(), as a filter on a projected column would be pushed below it and split the text for every use
    return docs.where(let(words(t), lambda ws: verdict(ordered, Facts.of(t, ws))).isNull())


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the counts that the rules rest on, base_failed, and kept: no base rule rejects, and then no other one.

    The counts are wanted of every row, so each is evaluated once and the rules take it from there; other rules run only
    where the base rules let a row pass.
    """
    ordered = [r for r in order_rules(docs, text, rules) if r not in BASE_RULES]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = base.select("doc_id", "text", words(F.col("text")).alias("words"))
    facts = Facts.of(F.col("text"), F.col("words"))
    counted = held.select("doc_id", *(v.alias(k) for k, v in facts._asdict().items()))
    known = Facts(*(F.col(k) for k in Facts._fields))
    failed = F.coalesce(BASE_RULES[0].fails(known) | BASE_RULES[1].fails(known), F.lit(False))
    kept = F.when(failed, F.lit(False)).otherwise(verdict(ordered, known).isNull())
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}')) AS up, len(regexp_extract_all(t, '\p{Ll}')) AS low
  FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 40 * n_words OR up > low) AS kept
FROM b
"""
