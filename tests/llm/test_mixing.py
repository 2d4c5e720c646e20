import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    return [(d, " ".join(["w"] * rng.randint(1, 60)) + ("\n#|#" * 30 if rng.random() < 0.2 else ""), rng.choices(["en", "fr", None], [6, 3, 1])[0], rng.choices(["hot", "a", "b"], [8, 1, 1])[0]) for d in range(n)]


def brute(rows, targets, keep, temperature=mixing.TEMPERATURE):
    """doc_id -> (probability, kept) by plain loops. rows: (doc_id, text, lang, source)."""
    docs = [(d, {"source": s, "lang": lang, "topic": topic(t or "")}, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1, t or "") for d, t, lang, s in rows]
    total = sum(n for _, _, n, _ in docs)
    goal, by = {}, {}
    for m in mixing.MARGINS:
        have = Counter()
        for _, k, n, _ in docs:
            have[k[m]] += n
        given = targets.get(m, {})
        spare, unnamed = max(0.0, 1 - sum(given.values())), sum(n for k, n in have.items() if k not in given)
        raw = {k: given[k] if k in given else n / unnamed * spare for k, n in have.items()} if given else {}
        if not sum(raw.values()):
            raw = {k: (n / total) ** temperature for k, n in have.items()}
        goal[m] = {k: v / sum(raw.values()) * total for k, v in raw.items()}
        by[m] = dict.fromkeys(have, 1.0)
    factor = lambda k: math.prod(by[m][k[m]] for m in mixing.MARGINS)
    for _ in range(60):
        for m in mixing.MARGINS:
            have = Counter()
            for _, k, n, _ in docs:
                have[k[m]] += n * factor(k)
            for v in by[m]:
                by[m][v] *= goal[m][v] / have[v] if have[v] else 0
    scale = min(keep * total / sum(n * factor(k) for _, k, n, _ in docs), 1 / max(factor(k) for _, k, _, _ in docs))
    out = {}
    for d, k, _, t in docs:
        digest = hashlib.md5(f"{mixing.SEED}|{d}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        out[d] = (factor(k) * scale, int(digest[:13], 16) / 2**52 < factor(k) * scale)
    return out


def topic(text):
    if 20 * len(re.findall("[#*$%&|<>]", text)) > len(text):
        return "markup"
    return "brief" if len(text) < 600 else "list" if len(text) < 120 * (text.count("\n") + 1) else "prose"


@pytest.mark.parametrize("targets", [{}, mixing.TARGETS, {"source": {"hot": 0.5, "a": 0.2}, "lang": {"en": 1, "fr": 2}, "topic": {"nowhere": 3.0}}])
def test_against_brute_force(spark, targets):
    rows = corpus(400, 5)
    got = {r["doc_id"]: (r["mix_probability"], r["mix_kept"]) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), targets).collect()}
    want = brute(rows, targets, mixing.KEEP)
    assert {d: p for d, (p, _) in got.items()} == pytest.approx({d: p for d, (p, _) in want.items()}, rel=1e-4, abs=1e-9)
    assert sum(got[d][1] != want[d][1] for d in want) <= 1  # a draw that falls between two roundings


def test_sample_follows_targets(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    targets = {"source": {"hot": 0.5, "a": 0.25, "b": 0.25}, "lang": {"en": 0.5, "fr": 0.5}}
    out = mixing.mix(df, targets, keep=0.15).collect()
    kept = [r for r in out if r["mix_kept"]]
    total = sum(r["mix_tokens"] for r in kept)
    assert total == pytest.approx(0.15 * sum(r["mix_tokens"] for r in out), rel=0.15)
    for key, want in targets.items():
        for value, share in want.items():
            assert sum(r["mix_tokens"] for r in kept if r[key] == value) / total == pytest.approx(share, abs=0.06)
    assert not any(r["lang"] is None for r in kept)  # not among the targets, so its share is 0
    assert all(0 <= r["mix_probability"] <= 1 <= r["mix_weight"] for r in out)


def test_expected_tokens_meet_targets_exactly(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = mixing.mix(df, {"source": {"hot": 0.6, "a": 0.2, "b": 0.2}}, keep=0.2).collect()
    assert all(r["mix_weight"] == 1 for r in rows)  # no cell needs more than it has
    expected = sum(r["mix_tokens"] * r["mix_probability"] for r in rows)
    for s, share in (("hot", 0.6), ("a", 0.2), ("b", 0.2)):
        assert sum(r["mix_tokens"] * r["mix_probability"] for r in rows if r["source"] == s) / expected == pytest.approx(share, abs=1e-3)


def test_targets_are_met_at_production_parameters(spark):
    """At KEEP and TEMPERATURE some cells would need several times their tokens; the unweighted draw still meets every margin."""
    rows = mixing.mix(spark.createDataFrame(corpus(), SCHEMA)).collect()
    tokens = sum(r["mix_tokens"] for r in rows)
    expected = sum(r["mix_tokens"] * r["mix_probability"] for r in rows)
    assert all(r["mix_weight"] == 1 for r in rows) and 0 < expected < mixing.KEEP * tokens
    for column in ("source", "lang", "mix_topic"):
        have, got = {}, {}
        for r in rows:
            have[r[column]] = have.get(r[column], 0) + r["mix_tokens"]
            got[r[column]] = got.get(r[column], 0) + r["mix_tokens"] * r["mix_probability"]
        raw = {k: (v / tokens) ** mixing.TEMPERATURE for k, v in have.items()}
        for k in have:
            assert got[k] / expected == pytest.approx(raw[k] / sum(raw.values()), abs=1e-4), (column, k)


def test_nulls_and_the_callers_columns(spark):
    df = spark.createDataFrame(corpus(60), SCHEMA).withColumns({"mix_weight": F.lit(77), "row": F.lit("r"), "tokens": F.lit(None).cast("int")})
    for topics in (F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(1))):
        assert mixing.mix(df, topic=topics).count() == 60
    out = mixing.sample_mix(df)
    assert out.columns == df.columns and {r["mix_weight"] for r in out.collect()} == {77}


def test_draw_repeats_and_is_even(spark):
    df = spark.range(4000).select("id", mixing.draw(F.col("id"), F.lit("t")).alias("u"))
    u = {r["id"]: r["u"] for r in df.collect()}
    assert u == {r["id"]: r["u"] for r in df.repartition(7).collect()}
    values = np.array(list(u.values()))
    assert 0 <= values.min() and values.max() < 1 and abs(values.mean() - 0.5) < 0.03


def test_edge_cases(spark):
    schema = SCHEMA + ", want double, tokens int, topic string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0 == mixing.sample_mix(spark.createDataFrame([], schema)).count()
    rows = [(1, None, None, None, 1.0, 1, "x"), (1, "", "en", "a", 1.0, 1, "x"), (2, "w " * 200_000, "en", "a", 1.0, 1, "x"), (3, "same", "en", "a", 1.0, 1, "x"), (3, "same", "en", "a", 1.0, 1, "x"), (None, "t", "en", "a", 1.0, 1, "x")]
    out = mixing.mix(spark.createDataFrame(rows, schema), keep=1.0).collect()
    assert len(out) == 6 and sorted(r["mix_tokens"] for r in out) == [1, 1, 2, 2, 2, 200_001]
    same = [r["mix_kept"] for r in out if r["doc_id"] == 3]
    assert same[0] == same[1]
    assert mixing.sample_mix(spark.createDataFrame(rows, schema)).columns == [c.split()[0] for c in schema.split(", ")]
    unknown = mixing.mix(spark.createDataFrame(rows, schema), {"source": {"nowhere": 1.0}}).count()
    assert unknown == 6
