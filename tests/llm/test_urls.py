import random

import numpy as np
import pytest

from tessera.llm import urls
from tessera.llm.urls import Rule

SCHEMA = "page_id long, url string, html string"


def judged(spark, pages, **how):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, **how).collect()}


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://A.Example.ORG/es/x?q=1#f", ("a.example.org", "/es/x", "example.org/es/", "block")),
        ("https://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
        ("https://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
        ("x://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("http://b.com/fr/1", ("b.com", "/fr/1", "com/fr/", "allow")),
        ("http://b.com/de/1", ("b.com", "/de/1", "com/de/", "block")),
        ("http://b.com", ("b.com", "", None, "allow")),
        ("http://b.com?x=/de/", ("b.com", "", None, "allow")),
        ("http://b.com#/de/", ("b.com", "", None, "allow")),
        ("http://É.COM/\n?x", ("É.com", "/\n", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("://", ("", "", None, "allow")),
        ("a://b://c/d", ("b:", "//c/d", None, "allow")),
    ],
)
def test_rules(spark, url, want):
    assert judged(spark, [(url, None)])[0] == want


def test_longest_rule_wins_and_blocks_win_ties(spark):
    rules = [Rule("allow", "x.y/"), Rule("block", "x.y/a"), Rule("allow", "x.y/ab"), Rule("block", "x.y/ab")]
    got = judged(spark, [("s://x.y/", None), ("s://x.y/ac", None), ("s://x.y/abc", None)], rules=rules)
    assert [got[i][3] for i in range(3)] == ["allow", "block", "block"]
    many = [Rule("allow" if k % 2 else "block", f"h{k}.z/") for k in range(400)]
    got = judged(spark, [("s://a.h7.z/", None), ("s://h398.z/p", None), ("s://h400.z/", None)], rules=many)
    assert [got[i][2:] for i in range(3)] == [("h7.z/", "allow"), ("h398.z/", "block"), (None, "allow")]


def link(*hosts):
    return "".join(f'<a href="http://{h}/p">t</a>' for h in hosts)


def test_propagation_against_loops(spark):
    rules = [Rule("allow", "good/"), Rule("block", "bad/")]
    graph = {"good": ["a", "b", "b", "bad2"], "bad": ["c"], "a": ["b"], "c": ["bad"], "d": ["bad", "c"], "e": ["good"], "bad2": ["bad"], "b": []}
    pages = [(f"http://{h}/x", link(*out)) for h, out in graph.items()]
    count = {(h, o): out.count(o) for h, out in graph.items() for o in set(out) - {h}}

    def walk(seed, along):
        """Plain rounds of a random walk over all hosts; what hosts without a way on hold goes back to the seed."""
        ways = {h: {} for h in graph}
        for (a, b), n in count.items():
            ways[a if along else b][b if along else a] = n
        rank = {h: float(h == seed) for h in graph}
        for _ in range(300):
            new = dict.fromkeys(graph, 0.0)
            new[seed] += 0.15
            for h, r in rank.items():
                total = sum(ways[h].values())
                for o, n in ways[h].items():
                    new[o] += 0.85 * r * n / total
                if not total:
                    new[seed] += 0.85 * r
            rank = new
        return rank

    trust, distrust = walk("good", True), walk("bad", False)
    assert sum(trust.values()) == pytest.approx(1) == pytest.approx(sum(distrust.values()))
    edges = urls.host_edges(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], SCHEMA)).cache()
    for seed, along, want in (("good", True, trust), ("bad", False, distrust)):
        scores = urls.propagate(edges, spark.createDataFrame([(seed, 1.0)], "host string, score double"), 1e-9, 0.85, along)
        assert {r["host"]: r["score"] for r in scores.collect()} == pytest.approx({h: x for h, x in want.items() if x > 1e-12}, rel=1e-5)
    got = judged(spark, pages, rules=rules)
    for i, h in enumerate(graph):
        t, d = trust.get(h, 0), distrust.get(h, 0)
        want = "allow" if h == "good" else "block" if h == "bad" else "block" if d > 0.5 * (t + d) else "allow"
        assert got[i][3] == want, h
    assert {"bad2", "d"} <= {h for i, h in enumerate(graph) if got[i][3] == "block"}


def test_hosts_many_links_away(spark):
    """A chain of eleven hosts to a blocked one, and none of them with trust."""
    rules = [Rule("allow", "good/"), Rule("block", "bad/")]
    chain = [*(f"c{k}" for k in range(11, 0, -1)), "bad"]
    pages = [(f"http://{a}/x", link(b)) for a, b in zip(chain, chain[1:])] + [("http://bad/x", None), ("http://good/x", link("far")), ("http://far/x", None)]
    got = judged(spark, pages, rules=rules)
    assert {r[0] for r in got.values() if r[3] == "block"} == set(chain)


def test_scores_reach_the_fixed_point(spark):
    rng = random.Random(2)
    n = 12
    out = [[h for h in range(n) if h != k and rng.random() < 0.2] or [(k + 1) % n] for k in range(n)]
    pages = spark.createDataFrame([(k, f"http://h{k}/", link(*(f"h{h}" for h in to))) for k, to in enumerate(out)], SCHEMA)
    edges, seeds = urls.host_edges(pages).cache(), spark.createDataFrame([("h0", 0.7), ("h5", 0.3)], "host string, score double")
    linked = np.zeros((n, n))
    for k, to in enumerate(out):
        linked[k, to] = 1
    start = np.zeros(n)
    start[[0, 5]] = 0.7, 0.3
    for along, m in ((True, linked.T), (False, linked)):
        want = np.linalg.solve(np.eye(n) - 0.85 * m / np.maximum(m.sum(0), 1), start)
        want /= want.sum()
        got = {r["host"]: r["score"] for r in urls.propagate(edges, seeds, urls.TOLERANCE, 0.85, along).collect()}
        assert got == pytest.approx({f"h{k}": x for k, x in enumerate(want) if x > 0}, rel=1e-5)


def test_edge_cases(spark):
    df = spark.createDataFrame([], SCHEMA + ", host string, path string, rule string, score double")
    assert urls.filter_urls(df).count() == 0
    page = ("http://a.com/x", link("a.com") + '<a href=//B.com/x><a href="/local"><a HREF=\'HTTPS://c.net\'>' + "x" * 200_000)
    rows = spark.createDataFrame([(1, *page, "h", "p"), (1, *page, "h", "p"), (None, None, None, "h", "p")], SCHEMA + ", host string, verdict string")
    assert urls.filter_urls(rows).count() == 3
    assert {(r["src"], r["dst"], r["n"]) for r in urls.host_edges(rows).collect()} == {("a.com", "b.com", 2), ("a.com", "c.net", 2)}


def test_no_python_on_the_way(spark):
    """Native operators: no Python node in the plans of url filter, quality rules and chat formatting."""
    from tessera.llm import chat, quality

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "http://a.com/x", link("b.com"))], SCHEMA)
    for df in (urls.filter_urls(pages), quality.measure(docs), quality.filter_quality(docs), chat.digest(chat.format_conversations(turns))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))
