"""URL filter: rules by host and path, and link-graph propagation for what no rule fits.

Trust flows along links from hosts that a rule allows (personalised PageRank whose restarts go to those
hosts); distrust flows against links from hosts that a rule blocks: who links to a blocked host is
distrusted. Host edges are counted from the absolute links of the pages, pre-aggregated per host pair;
links inside a host are left out. A host is blocked where its distrust exceeds ``threshold`` times its
trust; a host that neither reaches is allowed.

Ranks are iterated until none changes by more than ``TOLERANCE`` of itself; a host that is reached first
in a round changes by all of it, so no host is too many links away.

The iterations are joins of the edge table with the current ranks; only the small per-host table is
written between them. Both sides of a join are written tables, so Spark splits the edges of a hot host, and
sums are pre-aggregated on each task. Ranks go back to the pages by a broadcast up to a checked number of
hosts, and beyond it by a join that is split in the same way. The mass of hosts without links is not dealt
out again: ranks are compared, not summed.

Edge cases: rows that repeat are judged one by one, and their links count as often; an empty table gives no
rows; other columns are left out, whatever their names; html of any length is searched whole; a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed
by the method; an empty host takes no part in the graph; null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, maybe_broadcast

DAMPING, THRESHOLD = 0.85, 1.0
#: Share of its rank by which no host's may still change when the iteration ends.
TOLERANCE = 1e-6

#: (verdict, host, path) of the shipped rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, as ``host + path``, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts. ``pages`` has ``host`` and the html."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*:)?(//[^"'\s>]+)"""), F.lit(2))
    found = pages.where(F.col(html_col).contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("link"))
    return found.select("src", host(F.concat(F.lit(":"), "link")).alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): PageRank over ``edges`` (src, dst, n) whose restarts follow ``seeds`` (host, mass); ranks of nothing are left out."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "share")
    start = materialize(seeds.select("host", "mass"), "seeds")
    rank = start.select("host", F.col("mass").alias("rank"))
    if share.isEmpty():
        return rank
    change, i, last = 1.0, 0, None
    while change > tolerance:
        moved = share.join(rank.select(F.col("host").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = start.join(moved, "host", "full_outer").select("host", (F.lit(1 - damping) * F.coalesce("mass", F.lit(0.0)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        # ranks that underflow to 0 are those of hosts that nothing reaches
        new = materialize(new.where("rank > 0").join(rank.withColumnRenamed("rank", "old"), "host", "left"), f"rank{i}")
        change = new.agg(F.max(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) / F.col("rank"))).first()[0] or 0.0
        if last is not None:
            drop(last)
        rank, last, i = new.select("host", "rank"), new, i + 1
    return rank


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict, trust and distrust of its host."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("html")).withColumns({"host": host(F.col("u")), "path": path(F.col("u"))})
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": name, "ruled": verdict})
    edges = materialize(host_edges(p), "hostlinks")
    seeds = materialize(p.where("host != ''").groupBy("host").agg(F.avg((F.col("ruled") == "allow").cast("double")).alias("a"), F.avg((F.col("ruled") == "block").cast("double")).alias("b")), "hosts")
    seeds = seeds.select("host", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    trust = page_rank(edges, seeds.select("host", F.col("a").alias("mass")).where("mass > 0"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = page_rank(back, seeds.select("host", F.col("b").alias("mass")).where("mass > 0"))
    ranks = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full_outer")
    ranks = materialize(ranks.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "ranks")
    out = p.drop("html", "u").join(maybe_broadcast(ranks, ranks.count()), "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), "block").otherwise("allow")
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
