"""URL filtering: longest-match rules, and trust and distrust propagated over the host link graph.

Hosts are nodes; an edge (source host, target host) has the share of the source's outgoing links that point at the
target. Trust is personalised PageRank from hosts in proportion to their share of pages that rules allow; distrust is
the same from blocked pages over reversed edges, so that hosts linking to bad hosts become suspect. Scores are whole
numbers of 2 ** -40, as decimals of 26 digits, and damped edge shares have 8 digits behind the point, so sums do not depend
on their order and reruns agree. A seed is at most 1 and n seeds bring a host at most n, so a hub that very many hosts link
to fits 26 digits up to 10 ** 13 hosts. Steps are taken until no score changes by TOLERANCE: what is still to come falls by
0.85 a step, so that is after some log(n / TOLERANCE) / log(1 / 0.85) steps, 210 for 10 ** 9 hosts. Pages without a rule take their host's verdict: blocked if its evidence reaches the threshold and exceeds trust. Evidence is the
host's distrust or, where that is more, the mean distrust of the hosts that its links point at, each counted up to what a
host with blocked pages only has of itself. Reversed links divide a host's distrust among all that link to it, so a farm's
hosts get little each; the mean is not divided and finds them, however many they are.

Edge cases: null urls and urls without :// have an empty host and path and belong to the host ''; relative links and
links of a host to itself are no edges; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small, stage

#: (verdict, host, path); the text of a rule is host + path.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A score of 1; the type of scores; the denominator of damped link shares, and their type.
UNIT, SCORE = 2**40, "decimal(26, 0)"
SHARE, PART = 10**8, "decimal(9, 8)"
#: Damping as 17 / 20, the number of steps that the SQL writes out, and the share of UNIT at which evidence blocks a host.
DAMP_UP, DAMP_DOWN, STEPS = 17, 20, 60
BLOCK_AT = UNIT * 3 // 20 * 9 // 10
#: The distrust of a host whose pages are all blocked, without what its links bring.
FULL = UNIT * (DAMP_DOWN - DAMP_UP) // DAMP_DOWN
#: Propagation ends when no score changes by so much in STRIDE steps, after which it is staged and compared.
TOLERANCE, STRIDE = UNIT // 1_000_000, 3
BROADCAST_HOSTS = 200_000
URL = "://([^/?#]*)([^?#]*)"
#: Links: in any case, in double, single or no quotes.
LINK = r"""(?i)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def matched(rules: Sequence[Rule], value) -> Column:
    """value(rule) of the longest rule that fits host and path; null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, summed over all pages."""
    written = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 0)
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.filter(written, lambda x: x.contains("//"))).alias("link"))
    links = links.select("src", F.concat(*(F.regexp_extract("link", LINK, k) for k in (1, 2, 3))).alias("href"))
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    found = links.where(F.col("href").contains("//")).select("src", host_of(target).alias("dst"))
    return found.where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(host, kind, score) from seeds (host, kind, seed) over links (src, dst, kind, share), when no score changes by tolerance any more.

    share is damped(). Each step is one join and one sum by (kind, host); what dangling hosts hold is not redealt. The rows of a
    step are pre-summed before the shuffle, so a host that very many link to costs one row a task.
    """
    start = seeds.select("host", "kind", F.expr(f"cast(seed * {DAMP_DOWN - DAMP_UP} div {DAMP_DOWN} as {SCORE})").alias("score"))
    if links.isEmpty():
        return start
    now = start = stage(start, "rank")
    change = tolerance = max(1, tolerance)
    while change >= tolerance:
        before = now
        for _ in range(STRIDE):
            moved = now.join(links, (now["host"] == links["src"]) & (now["kind"] == links["kind"])).select(F.col("dst").alias("host"), now["kind"], F.expr(f"cast(floor(score * share) as {SCORE})").alias("score"))
            now = start.unionByName(moved).groupBy("host", "kind").agg(F.sum("score").cast(SCORE).alias("score"))
        now = stage(now, "rank")
        grown = now.unionByName(before.withColumn("score", (-F.col("score")).cast(SCORE))).groupBy("host", "kind").agg(F.sum("score").alias("change"))
        change = grown.agg(F.coalesce(F.max("change"), F.lit(0))).first()[0]
    return now


def damped(links: str, all_links: str) -> Column:
    """0.85 times the share that links have in all_links, rounded down to 8 digits."""
    return F.expr(f"cast(cast({links} * {SHARE * DAMP_UP // DAMP_DOWN} div {all_links} as decimal(9, 0)) / {SHARE} as {PART})")


def aimed(links: DataFrame, scores: DataFrame) -> DataFrame:
    """(src, aim): the mean distrust, FULL at most, of the hosts that src's links point at, from links (src, dst, links) and scores (host, distrust)."""
    met = links.join(small(scores.select(F.col("host").alias("dst"), F.least("distrust", F.lit(FULL)).cast("long").alias("held")), BROADCAST_HOSTS), "dst", "left")
    return met.groupBy("src").agg(F.expr("sum(cast(links as decimal(19, 0)) * cast(coalesce(held, 0) as decimal(18, 0))) div sum(links)").cast("long").alias("aim"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, html: str = "html", tolerance: int = TOLERANCE, block_at: int = BLOCK_AT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (the host's scores in units of 1 / UNIT)."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("rule", matched(rules, lambda r: r[1] + r[2])).withColumn("rule_verdict", matched(rules, lambda r: r[0]))
    hosts = named.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("rule_verdict") == v, 1)).alias(v) for v in ("allow", "block")))
    seeds = hosts.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f"{v} * {UNIT} div n").alias("seed")) for k, v in ((0, "allow"), (1, "block"))))).alias("x")).select("host", "x.kind", "x.seed")
    between = stage(edges(pages, html), "edges")
    share = lambda by: between.groupBy(by).agg(F.sum("links").alias("all_links")).withColumnRenamed(by, "from")
    forward = between.join(share("src"), F.col("src") == F.col("from")).select("src", "dst", F.lit(0).alias("kind"), damped("links", "all_links").alias("share"))
    back = between.join(share("dst"), F.col("dst") == F.col("from")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("kind"), damped("links", "all_links").alias("share"))
    ranks = propagate(seeds, stage(forward.unionByName(back), "links"), tolerance)
    table = stage(ranks.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0)).cast(SCORE).alias(c) for k, c in ((0, "trust"), (1, "distrust")))), "scores")
    table = stage(table.join(aimed(between, table), F.col("host") == F.col("src"), "left").select("host", "trust", "distrust", F.greatest("distrust", F.col("aim").cast(SCORE)).alias("evidence")), "hosts")
    judged = named.join(small(table, BROADCAST_HOSTS), "host", "left")
    own = F.when((F.col("evidence") >= block_at) & (F.col("evidence") > F.col("trust")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), F.col("trust").cast("double").alias("trust"), F.col("distrust").cast("double").alias("distrust"))
