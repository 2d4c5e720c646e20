"""Steps that have to grow no faster than their input: what they shuffle, how often they look at a row, and what they hold."""

import random
import re
import time
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import files_of
from tessera.functions import pdf
from tessera.functions import text as T
from tessera.operators import chunking, keyword, knn, navigation, rows
from tessera.operators.rows import by_row
from tessera.plans import catalog

PROSE = [("a.txt", "The cat_1 sat, the cat_1\nécat cat x2 2x\r\n\nThe end\nthe cat_1"), ("b.txt", "the\nend of the END"), ("c.txt", ""), ("d.txt", "cat²\n_x _x _x")]
#: One path twice: its rows count as one file.
TWICE = [*PROSE, ("b.txt", "new end\nthe the")]


def by_line(files):
    """file_path, line_no, name: uses, from the plain list of all occurrences."""
    found = navigation.occurrences(files).groupBy("file_path", "line_no", "name").count().collect()
    return {(r["file_path"], r["line_no"], r["name"]): r["count"] for r in found}


@pytest.mark.parametrize("given", [PROSE, TWICE, []])
@pytest.mark.parametrize("batch", [1, 100_000])
def test_names_are_counted_by_file(spark, given, batch, monkeypatch):
    monkeypatch.setattr(rows, "WORDS", batch)
    files = files_of(spark, *given)
    want = by_line(files)
    got = [(r["file_path"], u["line_no"], r["name"], u["n"]) for r in navigation.name_lines(files).collect() for u in r["uses"]]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    for r in navigation.name_lines(files).collect():
        assert [u["line_no"] for u in r["uses"]] == sorted(u["line_no"] for u in r["uses"])
    sums = {}
    for (path, _, name), n in want.items():
        sums[path, name] = sums.get((path, name), 0) + n
    found = navigation.names(files).collect()
    assert len(found) == len(sums) and {(r["file_path"], r["name"]): r["n"] for r in found} == sums


@pytest.mark.parametrize("given", [PROSE, TWICE])
def test_counted_references_are_those_found_one_by_one(spark, given):
    files = files_of(spark, *given)
    first = F.get("uses", F.lit(0))["line_no"]
    used = navigation.name_lines(files).select("file_path", "name", "uses", F.array(F.struct(first.alias("start_line"), (first + 1).alias("end_line"))).alias("spans"), F.lit(0).alias("pre"), F.concat_ws(":", "file_path", "name").alias("def_id"))
    defs = used.select("file_path", "name", "pre", "def_id", F.inline("spans"))
    want = {tuple(r) for r in navigation.references(files, defs).groupBy("file_path", "line_no", "name", "target_id").count().collect()}
    got = [(r["file_path"], r["line_no"], r["name"], r["target_id"], r["uses"]) for r in navigation.referenced(used, defs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def shuffled(spark, df):
    """Rows that the exchanges of a run wrote."""
    def of(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        below = plan.children()
        return own + sum(of(below.apply(i)) for i in range(below.size()))

    run = df._jdf.queryExecution()
    run.executedPlan().executeCollect()
    return of(run.executedPlan())


def many(spark, n=60, words=400):
    dice = random.Random(1)
    return files_of(spark, *((f"{i}.txt", " ".join(f"w{dice.randrange(10**6)}" + "\n" * (k % 40 == 39) for k in range(words))) for i in range(n))).coalesce(2)


def test_names_of_a_file_are_not_shuffled(spark):
    """Only where a path repeats do a file's names pass a shuffle; before, every one of them did."""
    files = many(spark)
    assert navigation.name_lines(files).count() > 20_000
    assert shuffled(spark, navigation.name_lines(files)) < 500 > shuffled(spark, navigation.names(files))
    assert shuffled(spark, navigation.name_lines(files.unionByName(files.limit(1)))) > 20_000


@pytest.mark.parametrize("batch", [1, 100_000])
def test_postings_are_those_of_tokens(spark, batch, monkeypatch):
    """Words, lengths and limits as tokens() has them, a key's documents together."""
    monkeypatch.setattr(rows, "WORDS", batch)
    texts = [(1, "The the été_x ÉTÉ x²  " + "y" * 39 + " " + "z" * 40), (2, ""), (3, None), (4, "ΟΔΟΣ İx a1 ½ ٣ 漢字 a\u0301b"), (1, "the end"), (None, "null key")]
    for given in (texts, texts[:4]):
        chunks = spark.createDataFrame(given, "id long, content string")
        plain = chunks.select("id", T.tokens(F.col("content")).alias("t")).select("id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
        want = {tuple(r) for r in plain.groupBy("id", "term").agg(F.count("*"), F.max("length")).collect()}
        got = [tuple(r) for r in keyword.postings(chunks, "id").collect()]
        assert len(got) == len(want) and set(got) == want


def test_postings_are_not_shuffled(spark):
    """Before, every term of a document passed a shuffle."""
    files = many(spark)
    assert keyword.postings(files, "file_path").count() > 20_000 and shuffled(spark, keyword.postings(files, "file_path")) < 500


def test_by_row(spark):
    given = spark.createDataFrame([(1, 2), (None, 3)], "k long, n long")
    total = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in by_row(given, "k", lambda r: r, total).collect()} == {(1, 2), (None, 3)}
    assert {tuple(r) for r in by_row(given.union(given), "k", lambda r: r, total).collect()} == {(1, 4), (None, 6)}


def test_units_are_numbered_in_one_walk(spark):
    """Units that share their lines are told apart; before, every unit was held against all before it, which took minutes here."""
    n = 20_000
    text = "".join(f"fn a{i}() {{}} fn b{i}() {{}}\n" for i in range(n))
    began = time.monotonic()
    found = chunking.chunk_units(files_of(spark, ("a.rs", text))).select("start_line", "end_line", "chunk_id").collect()
    assert time.monotonic() - began < 60
    assert len(found) == 2 * n == len({r["chunk_id"] for r in found}) and {(r["start_line"], r["end_line"]) for r in found} == {(i, i) for i in range(1, n + 1)}


def test_units_past_the_last_line_are_numbered_as_they_are_cut(spark):
    files = files_of(spark, ("a.rs", "x\ny\n"))
    parse = lambda ext, text: [("f", 2, 2), ("f", 2, 3), ("f", 1, 2), ("f", 2, 9)]
    found = chunking.with_units(files, parse)
    assert [u["nth"] for u in found.head()["units"]] == [0, 1, 0, 2]
    ids = [r["chunk_id"] for r in chunking.chunk_by(found, chunking.unit_spans(F.col("content"), F.col("units"))).collect()]
    assert len(set(ids)) == 4


def vectors(x):
    return pa.RecordBatch.from_pydict({"key": pa.array(range(len(x))), "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), x.shape[1])})


@pytest.mark.parametrize("same", [False, True])
def test_batch_search_holds_little(same):
    """A task's memory hangs on its queries, not on a batch's rows or on how many are equally far; before, it held every pair at once."""
    dice = np.random.default_rng(1)
    q, x = dice.normal(size=(256, 64)), np.ones((10_000, 64)) if same else dice.normal(size=(10_000, 64))
    batch = vectors(x)
    tracemalloc.start()
    out = pa.Table.from_batches(knn.nearest(iter([batch]), np.arange(len(q)), q, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    x = x.astype(np.float32).astype(float)
    for i, vector in enumerate(q[:20]):
        d = ((x - vector) ** 2).sum(1)
        want = sorted(range(len(x)), key=lambda j: (d[j], j))[:5]
        assert out["key"].to_pylist()[5 * i : 5 * i + 5] == want and np.allclose(out["distance"].to_numpy()[5 * i : 5 * i + 5], d[want])
    few = pa.Table.from_batches(knn.nearest(iter([batch.slice(0, 0), batch.slice(0, 2), batch.slice(2, 1)]), np.arange(3), q[:3], 5))
    assert few["query_id"].to_pylist() == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def plain_markdown(text):
    """pdf.markdown() line by line, as a state that runs along the lines."""
    found, was = [], False
    for raw in re.split("\r?\n", text)[: -1 if not text or text.endswith("\n") else None]:
        line = raw.strip(pdf.SPACE)
        words = [w for w in re.split(f"[{pdf.SPACE}]+", line) if w]
        table = len(words) >= 3 and ("\t" in line or "  " in line)
        cells = [c.strip(" ") for c in (line.split("\t") if "\t" in line else [c for c in line.split("  ") if c.strip(" ")])]
        upper, letters = sum(unicodedata.category(c) == "Lu" for c in line), sum(unicodedata.category(c)[0] == "L" for c in line)
        size = len(line.encode())
        out = "\n" if was and not table else ""
        if table:
            out += f"| {' | '.join(cells)} |" + ("" if was else f"\n| {' | '.join('---' for _ in cells)} |")
        elif (letters and upper > 0.8 * letters and size < 100) or (line.endswith(":") and size < 80 and "://" not in line):
            out += ("## " if size < 30 else "### ") + line.rstrip(":") + "\n"
        else:
            out += line
        found.append(out + "\n")
        was = table
    return "".join(found)


def test_markdown_is_that_of_plain_loops(spark):
    dice = random.Random(3)
    pieces = ["A", "b", "É", " ", "  ", "\t", "\n", "\r\n", " ", " ", "\u0085", " ", ":", "://", "HEAD", "x  y  z\n", "a\tb\tc\n", "L" * 60, "\n\n"]
    texts = ["", "\n", "a  b  c", *("".join(dice.choice(pieces) for _ in range(dice.randrange(60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r["i"]: r["v"] for r in df.select("i", pdf.markdown(F.col("x")).alias("v")).collect()}
    assert got == {i: plain_markdown(t) for i, t in enumerate(texts)}


def test_markdown_of_a_long_text(spark):
    """Before, the result was copied anew for each of the lines: here some 50 GB in all."""
    text = "a line of words and words\n" * 60_000
    began = time.monotonic()
    row = spark.createDataFrame([(text,)], "x string").select(F.length(pdf.markdown(F.col("x"))).alias("n")).head()
    assert row["n"] == len(text) and time.monotonic() - began < 10


def test_bm25_of_postings_reads_them_twice(spark):
    """Once for what is known of the index, once for the terms' rows; before, a third time for the terms' frequencies."""
    files = files_of(spark, ("1.txt", "the cat sat on the mat"), ("2.txt", "a dog"), ("3.txt", "The THE dog"), ("4.txt", ""))
    index = keyword.postings(files, "file_path").where("tf > 0")
    seen = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    own = index.mapInArrow(task, index.schema)
    got = {r["file_path"]: r["keyword_score"] for r in keyword.bm25_postings(own, "the dog nowhere", "file_path").collect()}
    assert seen.value == 2 * index.count()
    assert got == pytest.approx({r["file_path"]: r["keyword_score"] for r in keyword.bm25_postings(index, "the dog nowhere", "file_path", stats=(3, 11 / 3)).collect()})
    assert keyword.bm25_postings(index, "?!", "file_path").count() == 0


def test_markdown_of_orders_aggregates_once(spark, sf_dir):
    """Lines of an order pass one exchange; before, they were grouped by line first, in another. Equal line numbers keep the largest line."""
    plan = catalog.queries()["pdf_markdown_tables"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
