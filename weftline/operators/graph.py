"""Web-graph operators over edges (src, dst[, weight])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.html import anchors_of, parse_anchors
from weftline.functions.urls import abs_link, domain, is_valid_link, normalize_url, resolve_url, strip_www
from weftline.session import bounded, bucketed, discard
from weftline.sources.sinks import ranked

# Anchors that say nothing of their target.
USELESS_ANCHORS = [
    "link", "this", "site", "click", "ref", "here", ".",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "older posts", "privacy policy", "links to this post", "no comments:", "comment", "comments", "skip to sidebar", "skip to main",
    "(3)", "(2)", "(1)", "(4)", "(5)", "(6)", "(7)", "(8)", "(9)", "(0)",
    "reply", "posts", "post", "click here", "?", "??", "???", "????", "leave a comment", "about", "contact", "contact us", "home",
    "edit", "skip to content", "blog", "login", "log in", "log out", "logout", "about us", "google", "read more", "events", "visit",
    "share", "report", "help", "modify", "email", "terms", "download", "menu", "faq", "faqs",
]


def resolve_links(anchors: DataFrame, up: bool = True) -> DataFrame:
    """(page_id, url, link, anchor) of (page_id, url, at, href, anchor): hrefs normalised, resolved, checked, without
    www.; of equal links of a page the first one's anchor; links to the page itself dropped."""
    # a generator of one row makes a value that later expressions name, instead of one that each of them holds a copy of
    once = lambda c: F.explode(F.array(c))
    full = anchors.select("page_id", "url", "at", "anchor", once(normalize_url(F.col("href"))).alias("href"))
    full = full.select("page_id", "url", "at", "anchor", once(resolve_url(F.col("url"), F.col("href"), up)).alias("link"))
    full = full.where(is_valid_link(F.col("link"), F.col("url"))).withColumn("link", strip_www(F.col("link")))
    first = full.groupBy("page_id", "url", "link").agg(F.min_by("anchor", "at").alias("anchor"))
    return first.where("link <> url")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link, anchor) of (page_id, url, html): all anchors that the HTML parser finds, '..' references resolved."""
    bounded(pages.sparkSession)
    found = pages.select("page_id", "url", F.posexplode(parse_anchors(F.col("html"))).alias("at", "a"))
    return resolve_links(found.select("page_id", "url", "at", "a.href", "a.anchor"))


def plain_page_links(pages: DataFrame) -> DataFrame:
    """Likewise in the JVM, for pages known to be written plainly: other anchors, and '..' references, are not seen."""
    found = pages.select("page_id", "url", F.posexplode(anchors_of(F.col("html"))).alias("at", "a"))
    return resolve_links(found.select("page_id", "url", "at", "a.href", "a.anchor"), up=False)


def domain_edges(links: DataFrame) -> DataFrame:
    """(src, dst, weight): links (url, link) between domains, counted; those within a domain too."""
    return links.groupBy(domain(F.col("url")).alias("src"), domain(F.col("link")).alias("dst")).agg(F.count("*").cast("int").alias("weight"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def out_neighbors(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node"), "weight")


def in_neighbors(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node"), "weight")


def inlink_count(links: DataFrame, target: str = "link") -> DataFrame:
    """(row_key, total_ref): links to each target, under its md5. Counted before the shuffle."""
    return links.groupBy(F.md5(target).alias("row_key")).agg(F.count("*").alias("total_ref"))


def top_anchors(links: DataFrame, n: int = 5) -> DataFrame:
    """(row_key, rank, anchor, n): the most frequent anchors of each target, ties by anchor. Useless ones are told before lower-casing."""
    useful = links.where(~F.col("anchor").isin(USELESS_ANCHORS) & F.col("anchor").isNotNull())
    counts = useful.groupBy(F.md5("link").alias("row_key"), F.lower("anchor").alias("anchor")).agg(F.count("*").alias("n"))
    return ranked(counts, ["row_key"], [F.desc("n"), F.asc("anchor")], n).select("row_key", "rank", "anchor", "n")


def clean_edges(edges: DataFrame, slice_: tuple[str, str] | None = None) -> DataFrame:
    """Distinct (src, dst) without fragments and self-links; of targets whose md5 is in (start, stop], if given."""
    no_hash = lambda c: ~F.contains(F.col(c), F.lit("#"))
    out = edges.where(no_hash("src") & no_hash("dst") & (F.col("src") != F.col("dst")))
    if slice_:
        out = out.where((F.md5("dst") > slice_[0]) & (F.md5("dst") <= slice_[1]))
    return out.select("src", "dst").distinct()


def from_adjacency(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) of (node, sinks), as often as they stand."""
    return nodes.select(F.col("node").alias("src"), F.explode("sinks").alias("dst"))


def to_adjacency(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, rank, sinks) of edges and (node, rank); the view for exchange, the operators stay with edges."""
    sinks = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("sinks"))
    return ranks.join(sinks, "node").select("node", "rank", "sinks")


def clean_adjacency(nodes: DataFrame) -> DataFrame:
    """(node, rank, sinks) without nodes whose name has a fragment; of the others the sinks without fragments, repeats
    and the node itself. Ranks stay."""
    kept = F.array_distinct(F.filter("sinks", lambda s: ~F.contains(s, F.lit("#")) & (s != F.col("node"))))
    return nodes.where(~F.contains(F.col("node"), F.lit("#"))).select("node", "rank", kept.alias("sinks"))


def with_self_loops(edges: DataFrame) -> DataFrame:
    """Edges (src, dst), made distinct, and a loop at every source."""
    return edges.select("src", "dst").unionByName(edges.select("src", F.col("src").alias("dst"))).distinct()


def only_sources(edges: DataFrame) -> DataFrame:
    """Edges whose target is a source. Spark broadcasts the sources where their size allows it."""
    return edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def pagerank_step(shares: DataFrame, ranks: DataFrame, damping: float = 0.85, in_order: bool = False) -> DataFrame:
    """One step on (src, dst, deg) and (node, rank): 0.15 + 0.85 * the ranks received. Nodes that nothing reaches
    vanish, and targets that are no sources keep no rank that goes on. A partition's ranks are hashed, so that the edges
    are not sorted in every step. ``in_order``: a node's parts are added one by one, by source, not in sums of
    partitions, whose last digits differ with the partitions; all parts are shuffled for it."""
    given = shares.join(ranks.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").select("src", "dst", (F.col("rank") / F.col("deg")).alias("part"))
    if in_order:
        n = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        given = given.repartition(n, "dst").sortWithinPartitions("dst", "src")
    return given.groupBy(F.col("dst").alias("node")).agg((F.lit(round(1 - damping, 12)) + F.lit(damping) * F.sum("part")).alias("rank"))


MANY_EDGES = 1 << 20  # from so many on, every step's ranks are written


def pagerank(edges: DataFrame, n: int = 30, self_loops: bool = False, restrict: bool = False, cut_every: int | None = None, in_order: bool = False, once: bool = False) -> DataFrame:
    """(node, rank) after n steps from rank 1 at every source; repeated edges count as often as they stand, or ``once``.
    ``in_order``: the same digits however the edges lie, for what compares ranks with exact values.

    Edges are shuffled once and lie on disk in buckets by source, and a step's sums come out dealt by node into as many
    partitions, so that a step's only shuffle is that of the parts, added up before it. Every few steps, or with many
    edges every one, the ranks are written likewise, which keeps the plan short and lets the steps' shuffles and the ranks
    before them go. Targets that are no sources go no further by themselves, and are dropped at the end.
    """
    if self_loops:
        edges = with_self_loops(edges)
    if restrict:
        edges = only_sources(edges)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select("src", "dst").repartition(parts, "src")
    dealt = dealt.distinct() if once else dealt
    shares = bucketed(dealt.withColumn("deg", F.count("*").over(Window.partitionBy("src"))), "src", "rank-edges", n=parts)
    sources = bucketed(shares.select(F.col("src").alias("node")).distinct(), "node", "rank-nodes", n=parts)
    if cut_every is None:
        cut_every = 1 if shares.count() >= MANY_EDGES else 5
    ranks, before = sources.withColumn("rank", F.lit(1.0)), None
    for i in range(n):
        ranks = pagerank_step(shares, ranks, in_order=in_order)
        if (i + 1) % cut_every == 0 and i + 1 < n:
            ranks = bucketed(ranks, "node", "ranks", n=parts)
            if before is not None:
                discard(before)
            before = ranks
    return ranks.join(sources, "node", "left_semi")


def split_shares(edges: DataFrame, part: int) -> DataFrame:
    """(src, part, dst, m, deg, parts): edges (src, dst) once each with how often they stand, their source's degree, and
    which of its parts they are dealt to, by hash of the target: a source of many edges has one for each ``part`` of them."""
    once = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    deg = once.groupBy("src").agg(F.sum("m").alias("deg"), F.ceil(F.count("*") / part).alias("parts"))
    return once.join(deg, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part"), "dst", "m", "deg", "parts")


def settled_pagerank(edges: DataFrame, steps: int = 40, tolerance: float = 0.0, part: int = 1 << 16, damping: float = 0.85, history: list[int] | None = None) -> DataFrame:
    """``pagerank`` by changes: (node, rank) after ``steps`` steps, or when no rank changes by more than ``tolerance``.

    A node keeps the sum it has received and how many nodes it came from. A step sends on only what ranks have changed by
    since they were last sent, from nodes that changed, and a node that nothing reaches any more takes back what it sent.
    Changes within the tolerance wait until they add up. Edges lie in buckets by source and part, so that a source of many
    edges is many tasks' work; its change is copied once for each part. ``history`` gets how many nodes changed, by step.
    """
    shares = bucketed(split_shares(edges, part), ["src", "part"], "rank-parts")
    sources = bucketed(shares.groupBy(F.col("src").alias("node")).agg(F.max("parts").alias("parts")), "node", "rank-sources")
    zero = F.lit(0.0)
    state = sources.select("node", zero.alias("s"), F.lit(0).cast("long").alias("c"), F.lit(1.0).alias("rank"), zero.alias("sent"), F.lit(0).alias("was"), F.lit(1.0).alias("change"), F.lit(1).alias("came"))
    moves = (F.col("change") != 0) | (F.col("came") != 0)
    for _ in range(steps):
        each = state.where(moves).select("node", "change", "came").join(sources, "node")
        dealt = each.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "change", "came")
        sums = dealt.join(shares, ["src", "part"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("m") * F.col("change") / F.col("deg")).alias("ds"), F.sum(F.col("m") * F.col("came")).alias("dc"))
        told = state.select("node", "s", "c", (F.col("sent") + F.col("change")).alias("sent"), (F.col("was") + F.col("came")).alias("was"))
        got = told.join(sums, "node", "full_outer").select(
            "node", (F.coalesce("s", zero) + F.coalesce("ds", zero)).alias("s"), (F.coalesce("c", F.lit(0)) + F.coalesce("dc", F.lit(0))).alias("c"), F.coalesce("sent", zero).alias("sent"), F.coalesce("was", F.lit(0)).alias("was"),
        )
        got = got.withColumn("rank", F.when(F.col("c") > 0, F.lit(1 - damping) + F.lit(damping) * F.col("s")).otherwise(zero))
        got = got.withColumn("came", F.when(F.col("c") > 0, 1).otherwise(0) - F.col("was")).withColumn("change", F.col("rank") - F.col("sent"))
        small = (F.abs("change") <= tolerance) & (F.col("came") == 0)
        state = bucketed(got.withColumn("change", F.when(small, 0.0).otherwise(F.col("change"))), "node", "rank-state")
        changed = state.where(moves).join(sources, "node", "left_semi").count()
        if history is not None:
            history.append(changed)
        if not changed:
            break
    return state.where("c > 0").join(sources, "node", "left_semi").select("node", "rank")


def page_pagerank(links: DataFrame, n: int = 30, slice_: tuple[str, str] | None = None) -> DataFrame:
    """(row_key, rank): page ranks under the pages' md5, from cleaned links (src, dst) and self-loops."""
    no_hash = lambda c: ~F.contains(F.col(c), F.lit("#"))
    kept = links.where(no_hash("src") & no_hash("dst"))
    if slice_:
        kept = kept.where((F.md5("dst") > slice_[0]) & (F.md5("dst") <= slice_[1]))
    sources = links.where(no_hash("src")).select("src").distinct().select("src", F.col("src").alias("dst"))
    return pagerank(kept.select("src", "dst").unionByName(sources), n, once=True).select(F.md5("node").alias("row_key"), "rank")


def rank_stats(ranks: DataFrame) -> DataFrame:
    """Sum, count and mean in one pass."""
    return ranks.agg(F.sum("rank").alias("total"), F.count("*").alias("n"), F.avg("rank").alias("mean"))


def top_subgraph(edges: DataFrame, ranks: DataFrame, n: int = 100, name: Column | None = None) -> DataFrame:
    """(src, dst, weight): the edges among the n nodes of highest rank, ties by node. ``name`` renames nodes (as abs_link) before."""
    top = ranks.orderBy(F.desc("rank"), F.asc("node")).limit(n).select("node")
    inside = edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", "weight")


def bare_names(edges: DataFrame) -> DataFrame:
    """Edges with their nodes' schemes cut off."""
    return edges.select(abs_link(F.col("src")).alias("src"), abs_link(F.col("dst")).alias("dst"), "weight")
