"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are counted by cell (source, language, topic). Raking gives every value of a margin a factor, so that the sums over
each of the three margins meet their targets; a cell's factor is the product of its three. A document's probability is its
cell's factor times one common scale; the scale makes the expected tokens the wanted share of all tokens, or less where a
cell would need a probability over one for that: the unweighted draw meets the targets at any `keep`, and `weight` is one.
The draw is a hash of the id and the text, so a run repeats and a lost executor changes nothing.

Tokens are added up with map-side combine, so a source with a third of all rows is one row a task. Then every source is
one row with its tokens by language and topic: a round sets the sources' factors there, in a scan, and sums what results
by language and topic. Only these few sums go to the driver, which sets the factors of languages and topics by them.
Rounds go on until no factor moves by more than TOLERANCE, or ROUNDS times, where targets contradict each other.

Edge cases: null source, language or topic is a value of its own; null or empty texts have one token, as every document
has an end, and texts of any length are counted whole; targets of values that don't exist are left out; values that a
margin's targets don't name share what these leave of one, by their tokens (nothing, if they sum up to one or more);
targets that name no existing value and leave nothing are as if not given; ties don't arise, as each row is drawn by
itself; repeated rows share one draw; an empty table gives no rows. sample_mix() returns the caller's columns as they
were; mix() puts its own in place of columns with their names.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

MARGINS = ("source", "lang", "topic")
#: A default target is a value's share of tokens to this power: large values shrink, small ones grow.
TEMPERATURE = 0.7
KEEP, ROUNDS, TOLERANCE, SEED = 0.8, 50, 1e-6, "mix-1"
NULL = "\0null"
#: What the registered query and the pipeline mix to; sources keep the default.
TARGETS = {"lang": {"en": 0.56, "de": 0.15, "fr": 0.15, "es": 0.12}, "topic": {"prose": 0.84, "markup": 0.12}}


def default_topic(text: Column) -> Column:
    """A coarse topic by form: markup, list (short lines), brief, or prose."""
    n = F.char_length(text)
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return F.when(20 * F.regexp_count(text, F.lit("[#*$%&|<>]")) > n, "markup").when(n < 600, "brief").when(n < 120 * lines, "list").otherwise("prose")


def token_count(text: Column) -> Column:
    return (F.size(F.array_remove(F.split(text, SPACE), "")) + 1).cast("long")


def _counted(docs: DataFrame, topic: Column | None) -> DataFrame:
    """row (all columns of docs), source, lang, topic, tokens; columns of docs can't clash with ours."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = {"source": F.col("source"), "lang": F.col("lang"), "topic": default_topic(text) if topic is None else topic}
    return docs.select(F.struct("*").alias("row"), *(F.coalesce(v.cast("string"), F.lit(NULL)).alias(m) for m, v in key.items()), token_count(text).alias("tokens"))


def _goals(have: Mapping[str, float], given: Mapping[str, float] | None) -> dict[str, float]:
    """Share of every value of a margin; have: tokens by value."""
    total = sum(have.values())
    if given:
        spare, unnamed = max(0.0, 1 - sum(given.values())), sum(n for v, n in have.items() if v not in given)
        shares = {v: given[v] if v in given else n / unnamed * spare for v, n in have.items()}
        if whole := sum(shares.values()):
            return {v: x / whole for v, x in shares.items()}
    shares = {v: (n / total) ** TEMPERATURE for v, n in have.items()}
    return {v: x / sum(shares.values()) for v, x in shares.items()}


def _source_goals(sources: DataFrame, given: Mapping[str, float] | None, total: float) -> DataFrame:
    """sources (source, have, ...) with their goal in tokens, by the same rule as _goals()."""
    shares = sources.withColumn("share", F.pow(F.col("have") / total, TEMPERATURE))
    if given:
        named = sources.join(sources.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "source string, named double"), "source", "left")
        unnamed = named.agg(F.sum(F.when(F.col("named").isNull(), F.col("have")))).head()[0] or 1
        wanted = named.withColumn("share", F.coalesce("named", F.col("have") / unnamed * max(0.0, 1 - sum(given.values())))).drop("named")
        if wanted.agg(F.sum("share")).head()[0] > 0:
            shares = wanted
    whole = shares.agg(F.sum("share")).head()[0]
    return shares.withColumn("goal", F.col("share") / whole * total).drop("share")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with their factor. The sums of tokens times factor over each margin are its goals."""
    # languages x topics: a few hundred sums
    pairs = [(r["lang"], r["topic"], float(r["tokens"])) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("lang", "topic").collect()]
    if not pairs:
        return cells.withColumn("factor", F.lit(1.0))
    total = sum(n for *_, n in pairs)
    at, goal = [], []
    for k, m in enumerate(MARGINS[1:]):
        have: dict[str, float] = {}
        for p in pairs:
            have[p[k]] = have.get(p[k], 0.0) + p[2]
        values = sorted(have)
        at.append(np.array([values.index(p[k]) for p in pairs]))
        share = _goals(have, targets.get(m))
        goal.append(np.array([share[v] * total for v in values]))
    numbered = cells.sparkSession.createDataFrame([(lang, topic, k) for k, (lang, topic, _) in enumerate(pairs)], "lang string, topic string, pair int")
    sources = cells.join(numbered, ["lang", "topic"]).groupBy("source").agg(F.collect_list(F.struct("pair", "tokens")).alias("cells"), F.sum("tokens").alias("have"))
    sources = cut(_source_goals(cut(sources), targets.get("source"), total))
    by = [np.ones(len(g)) for g in goal]

    def fitted() -> DataFrame:
        """source, pair, tokens, factor with the sources' factors as those of languages and topics are now."""
        g = F.array(*map(F.lit, (by[0][at[0]] * by[1][at[1]]).tolist()))
        reached = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["tokens"] * F.get(g, c["pair"]))
        own = sources.select("source", "cells", F.when(reached > 0, F.col("goal") / reached).otherwise(0.0).alias("by"))
        return own.select("source", "by", F.explode("cells").alias("c")).select("source", "c.pair", "c.tokens", (F.col("by") * F.get(g, F.col("c.pair"))).alias("factor"))

    for _ in range(rounds):
        mass = np.zeros(len(pairs))
        for r in fitted().groupBy("pair").agg(F.sum(F.col("tokens") * F.col("factor")).alias("mass")).collect():
            mass[r["pair"]] = r["mass"]
        before = [b.copy() for b in by]
        for _ in range(rounds):
            for k in (0, 1):
                reached = np.bincount(at[k], weights=mass, minlength=len(goal[k]))
                step = np.divide(goal[k], reached, out=np.zeros(len(reached)), where=reached > 0)
                by[k] *= step
                mass *= step[at[k]]
        moved = [np.abs(b[o > 0] / o[o > 0] - 1).max(initial=0) for b, o in zip(by, before)]
        if max(moved) <= tolerance:
            break
    return fitted().join(numbered, "pair").select(*MARGINS, "tokens", "factor")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the row's id and text alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _drawn(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, keep: float, topic: Column | None, seed: str) -> DataFrame:
    """row, topic, tokens, probability, kept for every row of docs."""
    counted = _counted(docs, topic)
    fitted = cut(rake(cut(counted.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))), targets or {}))
    sums = fitted.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("factor")).alias("raked"), F.max("factor").alias("top")).head()
    # clipping a cell would miss its targets, so the largest factor times the scale is one at most
    scale = min(keep * sums["all"] / sums["raked"], 1 / sums["top"]) if sums["raked"] else 1.0
    fitted = fitted.select(*MARGINS, F.least(F.lit(1.0), F.col("factor") * scale).alias("probability"))
    out = counted.join(fitted, [*MARGINS])
    kept = draw(F.col("row.doc_id"), F.coalesce(F.col("row.text"), F.lit("")), seed) < F.col("probability")
    return out.select("row", F.nullif("topic", F.lit(NULL)).alias("topic"), "tokens", "probability", kept.alias("kept"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """docs with `mix_topic`, `mix_tokens`, `mix_probability`, `mix_weight` and `mix_kept` for every row."""
    own = {"mix_topic": F.col("topic"), "mix_tokens": F.col("tokens"), "mix_probability": F.col("probability"), "mix_weight": F.lit(1.0), "mix_kept": F.col("kept")}
    held = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in own]
    return _drawn(docs, targets, keep, topic, seed).select(*held, *(v.alias(k) for k, v in own.items()))


def sample_mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """The documents drawn, with the columns of docs."""
    return _drawn(docs, targets, keep, topic, seed).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
