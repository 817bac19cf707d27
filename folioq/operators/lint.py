"""Checks of pages and their links. Every rule gives rows (severity, kind, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioq.functions.text import is_iso
from folioq.operators import graph, names

TYPES = ("entity", "concept", "source", "topic")
DAY = 24 * 60 * 60
QUIET_AFTER = 90 * DAY
QUIET_KINDS = ("missing-sources", "missing-summary", "alias-collision", "expired-but-linked")
LINKED_FROM_SHOWN = 5


def _found(rows: DataFrame, severity: str, kind: str, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "id", (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def duplicate_ids(pages: DataFrame) -> DataFrame:
    return _found(pages.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "error", "duplicate-id", F.col("n"))


def broken_links(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """A finding for each link neither of whose forms is a page."""
    ids = pages.select("id").distinct()
    lost = edges.where("dst <> ''").join(ids.withColumnRenamed("id", "raw"), "raw", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return _found(lost.withColumnRenamed("src", "id"), "error", "broken-link", F.col("raw"))


def page_rules(pages: DataFrame) -> DataFrame:
    """The rules that look at one page only, in one pass."""
    no_sources = F.col("type").isin("entity", "concept") & (F.size(F.coalesce("sources", F.array().cast("array<string>"))) == 0)
    dates = [F.when(F.col(c).isNotNull() & ~is_iso(F.col(c)), F.concat_ws(" ", F.lit(c), F.col(c))) for c in ("valid_from", "valid_to")]
    crossed = F.when(is_iso(F.col("valid_from")) & is_iso(F.col("valid_to")) & (F.col("valid_from") > F.col("valid_to")), F.lit("valid_from after valid_to"))
    cells = F.exists(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: x.startswith("|") & x.rlike(r"\[\[[^\]]*\|[^\]]*\]\]"))
    marked = F.size(F.filter(F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(graph._MARKDOWN)), graph.markdown_target), lambda x: x.isNotNull()))
    rules = [
        ("error", "unregistered-type", ~F.col("type").isin(*TYPES), F.col("type")),
        ("warning", "missing-title", F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("")),
        ("warning", "wikilink-pipe-in-table-cell", cells, F.lit("")),
        ("warning", "non-canonical-wiki-link", marked > 0, marked),
        ("warning", "missing-sources", no_sources, F.lit("")),
        ("warning", "missing-summary", F.coalesce(F.trim("summary"), F.lit("")) == "", F.lit("")),
        *(("warning", "invalid-date", d.isNotNull(), d) for d in (*dates, crossed)),
    ]
    each = [F.when(F.coalesce(where, F.lit(True)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), detail.cast("string").alias("detail"))) for s, k, where, detail in rules]
    return pages.select("id", F.explode(F.filter(F.array(*each), lambda f: f.isNotNull())).alias("f")).select("f.severity", "f.kind", "id", "f.detail")


def reference_rules(pages: DataFrame) -> DataFrame:
    """Successors and sources that don't exist, and successor chains that return."""
    ids = pages.select(F.col("id").alias("to")).distinct()
    after = pages.where("coalesce(superseded_by, '') <> ''").select("id", F.col("superseded_by").alias("to"))
    dangling = _found(after.join(ids, "to", "left_anti"), "error", "dangling-supersede", F.col("to"))
    cycles = _found(graph.returning_chains(after.join(ids, "to", "left_semi").withColumnRenamed("to", "next")), "error", "supersede-cycle", F.col("length"))
    sources = pages.select("id", F.explode(F.coalesce("sources", F.array().cast("array<string>"))).alias("to"))
    lost = _found(sources.join(ids, "to", "left_anti"), "warning", "broken-source", F.col("to"))
    return dangling.unionByName(cycles).unionByName(lost)


def expired_but_linked(pages: DataFrame, edges: DataFrame, today: str) -> DataFrame:
    """Expired pages that current pages still link to, with the first few of them."""
    expired = is_iso(F.col("valid_to")) & (F.col("valid_to") < today)
    current = ~expired & (F.coalesce("superseded_by", F.lit("")) == "")
    old = pages.where(expired).select("id")
    alive = pages.where(current).select(F.col("id").alias("src"))
    both = edges.select("src", F.explode(F.array_distinct(F.array("raw", "dst"))).alias("id")).where("src <> id").distinct()
    met = both.join(old, "id", "left_semi").join(alive, "src", "left_semi")
    counts = met.groupBy("id").agg(F.count("*").alias("n"))
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("src"))).where(F.col("place") <= LINKED_FROM_SHOWN)
    shown = first.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("src")), ", ").alias("s"))
    more = F.when(F.col("n") > LINKED_FROM_SHOWN, F.concat(F.lit(" and "), (F.col("n") - LINKED_FROM_SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    return _found(shown.join(counts, "id"), "warning", "expired-but-linked", F.concat("s", more))


def orphans(pages: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """Pages that no other page links to, untouched for 90 days and not kept on purpose."""
    old = pages.where((F.col("file_mtime") > 0) & (F.col("file_mtime") < now - QUIET_AFTER) & ~F.coalesce("keep", F.lit(False)))
    return _found(old.join(graph.inbound(edges).select("id"), "id", "left_anti"), "warning", "orphan")


def frontmatter(files: DataFrame) -> DataFrame:
    """files: (path, error). A finding for each file that is no page."""
    return _found(files.where("error is not null").withColumnRenamed("path", "id"), "error", "frontmatter", F.col("error"))


def both_sides(pairs: DataFrame, kind: str, detail: Column | None = None) -> DataFrame:
    """pairs: (a, b). A finding for either page, naming the other."""
    said = F.lit("") if detail is None else F.concat(F.lit(" ("), detail, F.lit(")"))
    turned = [pairs.select(F.col(x).alias("id"), F.concat(F.col(y), said).alias("detail")) for x, y in (("a", "b"), ("b", "a"))]
    rows = turned[0].unionByName(turned[1])
    return _found(rows, "warning", kind, F.col("detail"))


def alias_collisions(pages: DataFrame) -> DataFrame:
    return both_sides(names.collisions(pages), "alias-collision")


def duplicate_candidates(pairs: DataFrame) -> DataFrame:
    """pairs: (a, b, similarity or null, by_title)."""
    title = F.when(F.col("by_title"), F.lit("same title"))
    return both_sides(pairs, "duplicate-candidate", F.concat_ws(", ", title, F.concat(F.lit("similarity "), F.format_number("similarity", 2))))


def notes(title_notes: DataFrame, content_notes: DataFrame, index_embedder: str | None, wanted_embedder: str) -> DataFrame:
    """title_notes: (type, key, pages), content_notes: (type, pages). Notes on what was not compared in full, and on an index of another embedder."""
    skipped = "duplicate-detection-skipped"
    shared = title_notes.select(F.lit("note").alias("severity"), F.lit(skipped).alias("kind"), F.lit("").alias("id"), F.format_string("%d pages of type %s share the title %s", "pages", "type", "key").alias("detail"))
    large = content_notes.select(F.lit("note").alias("severity"), F.lit(skipped).alias("kind"), F.lit("").alias("id"), F.format_string("type %s has %d pages: not all pairs compared", "type", "pages").alias("detail"))
    out = shared.unionByName(large)
    if index_embedder != wanted_embedder:
        one = title_notes.sparkSession.range(1).select(F.lit("note").alias("severity"), F.lit("hygiene-skipped").alias("kind"), F.lit("").alias("id"), F.lit(f"the index holds vectors of {index_embedder}, not of {wanted_embedder}").alias("detail"))
        out = out.unionByName(one)
    return out


def report(pages: DataFrame, today: str, now: int, files: DataFrame | None = None, vectors: DataFrame | None = None, index_embedder: str | None = None, wanted_embedder: str | None = None) -> DataFrame:
    """All findings. files: (path, error) of the vault; vectors: (id, type, embedding), compared only if both embedders are the same."""
    edges = graph.raw_edges(pages)
    parts = [duplicate_ids(pages), broken_links(pages, edges), page_rules(pages), reference_rules(pages), expired_but_linked(pages, edges, today), orphans(pages, edges, now), alias_collisions(pages)]
    if files is not None:
        parts.append(frontmatter(files))
    titles, title_notes = names.title_pairs(pages)
    none = pages.sparkSession.createDataFrame([], "id string, type string, embedding array<double>")
    used = vectors if vectors is not None and index_embedder == wanted_embedder else none
    contents, content_notes = names.content_pairs(used)
    apart = pages.select("id", F.coalesce("distinct_from", F.array().cast("array<string>")).alias("apart"))
    ranked = names.ranked_pairs(names._without_apart(titles, apart), names._without_apart(contents, apart), used)
    parts += [duplicate_candidates(ranked), notes(title_notes, content_notes, index_embedder, wanted_embedder)]
    return reduce(DataFrame.unionByName, parts)


def shown(findings: DataFrame, detailed: bool = False, kind: str | None = None) -> DataFrame:
    """Counts for each kind, or the findings themselves; kind keeps one kind only."""
    kept = findings if kind is None else findings.where(F.col("kind") == kind)
    return kept if detailed else kind_counts(kept)


def of_paths(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Findings of the written pages only."""
    return findings.join(ids.select("id").distinct(), "id", "left_semi")


def kind_counts(findings: DataFrame) -> DataFrame:
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.groupBy("severity", "kind").agg(F.count("*").alias("n")).orderBy(order, "kind")


def loud(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("kind").isin(*QUIET_KINDS))
