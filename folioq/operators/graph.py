"""The link graph: links in text, edges, degrees, components, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioq.functions.text import PAGE_TYPES

_WIKI = r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"
_MARKDOWN = r"\[[^\[\]]*\]\(([^()\s]+)\)"
HUB_SHARE = 0.15
ALL_LABELS_UNDER = 80
LABEL_ZOOM = 0.7


def markdown_target(raw: Column) -> Column:
    """The page id a markdown destination names, or null."""
    bare = F.regexp_replace(raw, r"^https?://tauri\.localhost/", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"\.md$", "")
    outside = F.lower(bare).rlike(r"^(#|/|mailto:|file:|javascript:|https?:)") | (bare == "")
    return F.when(~outside & path.rlike(rf"^({'|'.join(PAGE_TYPES)})/."), path)


def links(body: Column) -> Column:
    """Targets of wiki links, then of markdown links to pages, in order, with repeats."""
    b = F.coalesce(body, F.lit(""))
    wiki = F.transform(F.regexp_extract_all(b, F.lit(_WIKI)), lambda x: F.trim(x))
    marked = F.filter(F.transform(F.regexp_extract_all(b, F.lit(_MARKDOWN)), markdown_target), lambda x: x.isNotNull())
    return F.concat(wiki, marked)


def raw_edges(pages: DataFrame) -> DataFrame:
    """Rows (src, raw, dst), one for each link: raw as written, dst without #heading."""
    out = pages.select(F.col("id").alias("src"), F.explode(links(F.col("body"))).alias("raw"))
    return out.withColumn("dst", F.trim(F.substring_index("raw", "#", 1)))


def index_edges(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, broken), each pair once."""
    edges = raw_edges(pages).where("dst <> ''").select("src", "dst").distinct()
    known = pages.select(F.col("id").alias("dst"), F.lit(False).alias("broken")).distinct()
    return edges.join(known, "dst", "left").select("src", "dst", F.coalesce("broken", F.lit(True)).alias("broken"))


def broken_by_source(edges: DataFrame) -> DataFrame:
    return edges.where("broken").groupBy("src").agg(F.concat_ws(", ", F.sort_array(F.collect_set("dst"))).alias("targets"))


def backlinks(edges: DataFrame, target: str) -> DataFrame:
    """Pages that link to exactly this target, in order."""
    return edges.where(F.col("raw") == target).select("src").distinct().orderBy("src")


def inbound(edges: DataFrame) -> DataFrame:
    """Rows (id, inbound): distinct other sources; a link counts for its raw and its stripped target."""
    both = edges.select("src", F.explode(F.array_distinct(F.array("raw", "dst"))).alias("id")).where("id <> '' and src <> id")
    return both.distinct().groupBy("id").agg(F.count("*").alias("inbound"))


def filtered_graph(pages: DataFrame, edges: DataFrame, types: list[str] | None = None, tags: list[str] | None = None, after: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes by type, any of tags and date (undated pages pass), and the edges between them."""
    nodes = pages
    if types:
        nodes = nodes.where(F.col("type").isin(types))
    if tags:
        nodes = nodes.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if after:
        nodes = nodes.where(F.col("updated_at").isNull() | (F.col("updated_at") >= after))
    ids = nodes.select("id")
    inner = edges.select("src", F.col("raw").alias("dst")).distinct()
    inner = inner.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inner.select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hub_threshold(degree: DataFrame, share: float = HUB_SHARE) -> DataFrame:
    """One row: the degree at place floor(share * n) from the top.

    Degrees are counted by value first; the ordered list is one row for each different degree.
    """
    counts = degree.groupBy("degree").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("degree"))
    placed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("of", F.sum("n").over(Window.partitionBy()))
    return placed.where(F.col("upto") > F.least(F.floor(F.lit(share) * F.col("of")), F.col("of") - 1)).agg(F.max("degree").alias("threshold"))


def label_shown(n_nodes: Column, degree: Column, hub: Column, zoom: float) -> Column:
    return (n_nodes < ALL_LABELS_UNDER) | (degree >= hub) | F.lit(zoom >= LABEL_ZOOM)


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): the smallest id of each connected component, by hooking and pointer jumping."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    roots = both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")).checkpoint()
    while True:
        ends = both.join(roots.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(roots.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        offers = ends.select(F.explode(F.array("a", "ca")).alias("id"), F.col("cb").alias("component"))
        hooked = roots.unionByName(offers).groupBy("id").agg(F.min("component").alias("component"))
        jumps = hooked.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = hooked.join(jumps, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component")).checkpoint()
        if new.join(roots.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty():
            return new
        roots = new


def cluster_sizes(components: DataFrame) -> DataFrame:
    """components: (id, component). Rows (component, pages), the largest first."""
    return components.groupBy("component").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "component")


def returning_chains(successors: DataFrame) -> DataFrame:
    """successors: (id, next). Rows (id, length) of ids whose chain of successors comes back to them.

    Doubles the step each round: log2 of the longest chain joins, whatever the chains look like.
    """
    steps = successors.where("next is not null").select("id", "next").dropDuplicates(["id"]).checkpoint()
    ids = steps.select("id")
    jumps, left, power = steps, ids.count(), 0
    while 2**power < max(1, left):
        later = jumps.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jumps = jumps.join(later, "next").select("id", F.col("after").alias("next")).checkpoint()
        power += 1
    # What is still reachable after at least as many steps as there are pages lies on a cycle.
    on_cycle = jumps.select(F.col("next").alias("id")).distinct()
    ring = steps.join(on_cycle, "id", "left_semi")
    names = components(ring.select(F.col("id").alias("src"), F.col("next").alias("dst")))
    sizes = names.groupBy("component").agg(F.count("*").alias("length"))
    return names.join(sizes, "component").select("id", "length")


def last_positions(moves: DataFrame) -> DataFrame:
    """moves: (id, x, y, updated_at). The last of each id."""
    return moves.groupBy("id").agg(F.max_by(F.struct("x", "y", "updated_at"), F.struct("updated_at", "x", "y")).alias("last")).select("id", "last.*")
