"""URL filtering by rules and by propagation over the link graph of hosts.

Rules decide the pages they fit. Hosts whose pages rules allow are trusted
seeds, hosts whose pages rules block are distrusted ones, each by the share of
its pages. Trust runs along links (personalised PageRank from the trusted
seeds). Distrust runs from the blocked seeds over the reversed links (who links
to bad hosts is suspect): a host takes the distrust of the hosts it links to,
each by its share of the host's own links. That is the part of the personalised
PageRank started at the host that ends on blocked seeds, between 0 and 1: one
linker of a blocked host or thousands get the same distrust, and a host with
few bad links among many gets little. A page no rule fits gets its host's
verdict: block where distrust exceeds trust by the threshold.

Links are counted per pair of hosts before anything is joined, so a host with
a third of all pages is one seed row and one row for each host that it links to.
Each round is a join of the edges with the stored ranks and a sum per host;
the ranks are written to the shared folder every few rounds.

Behaviour on awkward input: a null url or one without ``://`` has empty host and
path, fits no rule and is allowed (the empty host takes no part in the graph);
null html has no links; a link counts once per page and target host; links
inside a host count for nothing; repeated rows count each; long pages are read
whole; an empty table gives an empty result; only the id, url and html columns
are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import ascii_lower, stored

DAMPING, ROUNDS, STORE_EVERY = 0.85, 20, 5
#: A host is blocked where distrust - trust exceeds this (by more than rounding); an unlinked host with all pages blocked has 1 - DAMPING.
THRESHOLD = 0.075
#: Ranks that no longer change by more than this are final.
SETTLED = 1e-9

LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = (F.when(fits, F.lit(rule_host + rule_path)).otherwise(name),
                         F.when(fits, F.lit(what)).otherwise(verdict))
    return name, verdict


def judged_by_rules(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
                    html_col: str | None = None) -> DataFrame:
    """``page_id, host, path, rule, ruled`` and, if asked for, ``html``."""
    extra = [F.col(f"`{html_col}`").alias("html")] if html_col else []
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("__url"), *extra)
    host, path = host_and_path(F.col("__url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, ruled = match_rules(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": ruled}).drop("__url")


def seeds(judged: DataFrame) -> DataFrame:
    """``host, trusted, blocked``: shares of each host's pages that rules allow and block."""
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    return judged.where("host != ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))


def host_links(judged: DataFrame) -> DataFrame:
    """``src, dst, share``: links between hosts, one per page and target, as shares of all links out of the source."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), ascii_lower))
    links = (judged.where("host != ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
             .where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    links = stored(links, "host-links")
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    return links.hint("merge").join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))


def propagate(start: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` from ``start`` (host, trusted, blocked) over ``links``."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("host"))
    nodes = stored(start.unionByName(ends.select("host", F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked")))
                   .groupBy("host").agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")), "hosts")
    kept = 1 - damping
    ranks = nodes.select("host", (kept * F.col("trusted")).alias("trust"), (kept * F.col("blocked")).alias("distrust"))
    if links.isEmpty():
        return ranks
    for i in range(1, rounds + 1):
        last = ranks
        a = links.hint("merge").join(last, F.col("src") == F.col("host")).select(
            F.col("dst").alias("to"), (F.col("trust") * F.col("share")).alias("t"), F.lit(0.0).alias("d"))
        b = links.hint("merge").join(last, F.col("dst") == F.col("host")).select(
            F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("share")).alias("d"))
        flow = a.unionAll(b).groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        ranks = nodes.hint("merge").join(flow, nodes["host"] == flow["to"], "left").select(
            "host", (kept * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (kept * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        if i % STORE_EVERY == 0 and i < rounds:
            ranks = stored(ranks, "host-ranks")
            moved = ranks.alias("a").join(last.alias("b"), "host").agg(
                F.max(F.greatest(F.abs(F.col("a.trust") - F.col("b.trust")), F.abs(F.col("a.distrust") - F.col("b.distrust")))))
            if moved.first()[0] < SETTLED:
                break
    return ranks


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    judged = judged_by_rules(pages, rules, id_col, url_col, html_col)
    links = stored(host_links(judged), "host-shares")
    ranks = propagate(seeds(judged), links)
    bad = ranks.where(F.col("distrust") - F.col("trust") > threshold + SETTLED).select(F.col("host").alias("bad"))
    rows = judged_by_rules(pages, rules, id_col, url_col)
    return rows.hint("merge").join(bad, rows["host"] == bad["bad"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
