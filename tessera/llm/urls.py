"""URL filters by rules and link-graph propagation (native: DataFrame functions only).

A rule names a host with its subdomains and a path prefix; the longest rule that fits decides. For urls without a rule
the link graph decides: personalised PageRank flows from trusted hosts along host edges, distrust flows from blocked
hosts against them. Either walk leaves a host by its edges' shares in the walk's direction, and returns to its seeds from
hosts without any; so both distribute one unit over the hosts, and a host is blocked where distrust is more than its share
of the two. Rounds go on until no host is new and no score moves by more than TOLERANCE of itself; so hosts any number of
links away are judged. `oracle` writes out a given number of rounds, as SQL of one statement does, and agrees where these
suffice.

Edge cases: a null url, or one without `://`, has an empty host and path and is allowed by default; a null html has no
links, and one of any length is searched whole; a host without any evidence is allowed, and so is one with as much trust
as distrust; of rules as long as each other a block wins; self links and links to nowhere carry nothing; repeated pages
are judged one by one; an empty table gives no rows; columns other than page_id, url and html are not read, whatever their
names. Rules may be any number; they are tried one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Scores stand where every host's moves by at most this share of itself in a round.
TOLERANCE = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative links in an attribute; group 1 is the host.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


DEFAULT_RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits; null where none does. Of equal rules a block wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != "block", r.pattern))
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in (("host", r.host), ("path", r.path), ("pattern", r.pattern), ("verdict", r.verdict)))) for r in ordered))
    first = F.get(F.filter(listed, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])), F.lit(0))
    return first["pattern"], first["verdict"]


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: how many links lead from one host to another. Counted per pair before anything is joined."""
    host, _ = split_url(F.col(url))
    links = pages.where(F.col(html).contains("//")).select(host.alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float, damping: float, along: bool) -> DataFrame:
    """host, score at the fixed point, summing up to one as the seeds (host, score) do. along=False walks the edges backwards.

    What hosts without edges hold goes back to the seeds. As that is a multiple of the seeds, it changes the fixed point by
    a common factor only, which is set at the end.
    """
    a, b = ("src", "dst") if along else ("dst", "src")
    edges = edges.join(edges.groupBy(a).agg(F.sum("n").alias("total")), a).select(a, b, (F.col("n") / F.col("total")).alias("weight"))
    edges = cut(edges)
    rank, restart = seeds, seeds.select("host", (F.col("score") * (1 - damping)).alias("score"))
    for k in count(1):
        flow = edges.join(rank, edges[a] == rank["host"]).select(F.col(b).alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))
        moved = flow.unionByName(restart)
        if k % 3:
            rank = moved.groupBy("host").agg(F.sum("score").alias("score"))
            continue
        # every third round has the scores of the round before beside it; a host that is new has none
        both = moved.withColumn("before", F.lit(0.0)).unionByName(rank.select("host", F.lit(0.0).alias("score"), F.col("score").alias("before")))
        both = cut(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")))
        rank = both.select("host", "score")
        if both.where(F.abs(F.col("score") - F.col("before")) > tolerance * F.col("score")).isEmpty():
            whole = rank.agg(F.sum("score")).head()[0]
            return rank.select("host", (F.col("score") / (whole or 1.0)).alias("score"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, tolerance: float = TOLERANCE, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"))
    seeds = judged.where("rule IS NOT NULL").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    seeds = cut(seeds)
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).head()  # two numbers
    trusted = seeds.where("good > 0").select("host", (F.col("good") / (total["good"] or 1)).alias("score"))
    blocked = seeds.where("bad > 0").select("host", (F.col("bad") / (total["bad"] or 1)).alias("score"))
    edges = cut(host_edges(pages))
    if not edges.isEmpty():
        trusted, blocked = propagate(edges, trusted, tolerance, damping, True), propagate(edges, blocked, tolerance, damping, False)
    both = trusted.select("host", F.col("score").alias("t"), F.lit(0.0).alias("d")).unionByName(blocked.select("host", F.lit(0.0).alias("t"), F.col("score").alias("d")))
    hosts = both.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).where(F.col("d") > threshold * (F.col("t") + F.col("d"))).select("host", F.lit("block").alias("by_graph"))
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))


def oracle(rules: Sequence[Rule] = DEFAULT_RULES, rounds: int = 6, damping: float = 0.85, threshold: float = 0.5) -> str:
    """The same in SQL, with the rounds written out."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != "block", r.pattern))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in ordered) + " END"
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    host = low("CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1, 's') ELSE '' END")
    path = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END"
    link = LINK.replace("(?i)", "").replace("'", "''")
    parts = [
        f"p AS (SELECT page_id, coalesce({host}, '') AS host, coalesce({path}, '') AS path, html FROM pages)",
        f"j AS (SELECT page_id, host, path, {case('pattern')} AS rule, {case('verdict')} AS by_rule FROM p)",
        "s AS (SELECT host, count(*) FILTER (WHERE by_rule = 'allow') AS good, count(*) FILTER (WHERE by_rule = 'block') AS bad FROM j WHERE rule IS NOT NULL GROUP BY host)",
        f"l AS (SELECT host AS src, {low('unnest(regexp_extract_all(html, ' + chr(39) + link + chr(39) + ', 1, ' + chr(39) + 'i' + chr(39) + '))')} AS dst FROM p)",
        "c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS t_weight, n / sum(n) OVER (PARTITION BY dst) AS d_weight FROM c)",
        "t0 AS (SELECT host, good / (SELECT sum(good) FROM s) AS score FROM s WHERE good > 0)",
        "d0 AS (SELECT host, bad / (SELECT sum(bad) FROM s) AS score FROM s WHERE bad > 0)",
    ]
    for x, a, b in (("t", "src", "dst"), ("d", "dst", "src")):
        for k in range(rounds):
            parts.append(f"{x}{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT {b} AS host, score * {x}_weight * {damping} AS score FROM e JOIN {x}{k} ON {a} = host UNION ALL SELECT host, score * {1 - damping} FROM {x}0) GROUP BY host)")
    parts.append(f"b AS (SELECT host FROM (SELECT host, score / (SELECT sum(score) FROM t{rounds}) AS t, 0 AS d FROM t{rounds} UNION ALL SELECT host, 0, score / (SELECT sum(score) FROM d{rounds}) FROM d{rounds}) GROUP BY host HAVING sum(d) > {threshold} * (sum(t) + sum(d)))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, j.host, j.path, rule, coalesce(by_rule, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN b USING (host)"
