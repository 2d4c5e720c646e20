import random
import re

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "bé", "C#", "dd", "#*", "Ünï", "x" * 50, "e|f"]
    seps = [" ", "\n", "\t", "  ", "\r\n", "\x0b", "\u00a0", "\n\n"]
    return ["".join(rng.choice(words[: rng.randint(2, 8)]) + rng.choice(seps) for _ in range(rng.choice([0, 2, 3, 60, 120]))) for _ in range(n)]


def test_counts(spark):
    ts = [*texts(1), None, "", " \n\t", "one two", "x y z " * 30]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.measure(df).collect()}
    for i, t in enumerate(ts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), (i, t)
        assert not (r["base_failed"] and r["kept"])


def test_order_does_not_change_verdicts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(2, 40))], "doc_id long, text string")
    rules = list(quality.RULES)
    from pyspark.sql import functions as F

    def kept(order):
        w = quality.words(F.col("text"))
        return {r["doc_id"] for r in df.where(quality.let(w, lambda x: quality.verdict(order, quality.Facts.of(F.col("text"), x))).isNull()).collect()}

    want = kept(rules)
    assert kept(rules[::-1]) == want == {r["doc_id"] for r in quality.filter_quality(df).collect()}
    assert want == {r["doc_id"] for r in quality.measure(df).where("kept").collect()}


def test_cheap_rejections_come_first(spark):
    rng = random.Random(3)
    bad = ["short text"] * 300
    good = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=100)) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "doc_id long, text string")
    ordered = quality.order_rules(df)
    assert ordered[0].name == "few_words" and {r.name for r in ordered} == {r.name for r in quality.RULES}


def test_clean_prose_stays(spark):
    df = spark.createDataFrame([(1, "Clean sentences of many different words. " + " ".join(f"word{i}" for i in range(100)))], "doc_id long, text string")
    assert quality.filter_quality(df).count() == 1


def test_edge_cases(spark):
    schema = "doc_id long, text string, t int, w int, n_words int, kept int"
    assert quality.measure(spark.createDataFrame([], schema)).count() == 0 == quality.filter_quality(spark.createDataFrame([], schema)).count()
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    df = spark.createDataFrame([(1, long, 1, 1, 1, 1), (1, long, 1, 1, 1, 1), (None, "w " * 60, 1, 1, 1, 1)], schema)
    rows = quality.measure(df).collect()
    assert sorted(r["n_words"] for r in rows) == [60, 200_000, 200_000]
    assert quality.filter_quality(df).columns == df.columns
