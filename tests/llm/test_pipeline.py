import os
import random
import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import mixing, packing, quality
from test_mixing import brute as drawn
from test_neardup import brute as components
from test_packing import check
from test_quality import brute as counts
from test_suffix import N

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=7, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "ber", "cor", "dé") for b in range(300)]
    shared = " ".join(rng.choices(words, k=60))
    docs = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.1:
            text = "too short"
        elif kind < 0.2:
            text = "again and again " * 40
        elif kind < 0.35 and docs:
            text = rng.choice(docs)[1] or ""
            text = text.replace("al1 ", "changed ", 1)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(60, 400)))
            if kind < 0.6:
                text = text[: len(text) // 2] + " " + shared + " " + text[len(text) // 2 :]
        docs.append((d, text, rng.choice(["en", "fr", None]), rng.choices(["hot", "cold"], [4, 1])[0], len(text)))
    return [*docs, (900, None, "en", "hot", None), (901, "", "en", "hot", 0)]


def brute_kept(docs):
    """Documents (doc_id, text) after quality rules, near-dedup and suffix dedup, by all pairs and all strings."""
    import re

    def passes(t):
        n, chars, symbols, dup, _, failed = counts(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
        return not (failed or 2 * symbols > n or 2 * dup > lines or chars > 40 * n or upper > lower)

    held = {d: t or "" for d, t, *_ in docs if passes(t or "")}
    comp = components(held, 5)
    held = {d: t for d, t in held.items() if comp[d][1] == d}
    seen, out = set(), {}
    for d in sorted(held):
        x = held[d].encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - N + 1):
            if (s := x[k : k + N]) in seen:
                gone[k : k + N] = True
            seen.add(s)
        if left := np.frombuffer(x, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"):
            out[d] = left
    return out


def test_against_brute_force(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "pack_sequences"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != names[-1]:
            assert out.dtypes == now.dtypes
        out.write.parquet(str(tmp_path / name))
        now = stages[name] = spark.read.parquet(str(tmp_path / name))
    deduplicated = {r["doc_id"]: r for r in stages["suffix_dedup"].collect()}
    want = brute_kept(docs)
    assert {d: r["text"] for d, r in deduplicated.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in deduplicated.values())
    mixed = {r["doc_id"]: r["text"] for r in stages["mix_sources"].collect()}
    chances = drawn([(d, r["text"], r["lang"], r["source"]) for d, r in deduplicated.items()], mixing.TARGETS, mixing.KEEP)
    assert mixed.items() <= want.items() and set(mixed) == {d for d, (_, kept) in chances.items() if kept}
    check(stages["pack_sequences"].collect(), list(mixed.items()), packing.CAPACITY)
    whole = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert {(d, s) for d, s, _, _ in whole if s == 0} == {(d, 0) for d in mixed}


def test_every_stage_takes_an_empty_table(spark):
    now = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_registered():
    found = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert found["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert [r.name for r in quality.BASE_RULES] == ["few_words", "repeated_words"]


def test_the_rest_works_without_this_part(tmp_path):
    """The entry file imports, and has its other queries, where the operators' folders are gone."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = textwrap.dedent("""
        import __spark_entry__ as e
        q = e.queries()
        assert "hybrid_rrf" in q and not any(k.startswith("op") or k == "pipeline" for k in q), q
        assert set(e.oracle_sql()) <= set(q)
    """)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
