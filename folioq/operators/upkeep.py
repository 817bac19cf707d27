"""The work queue, its log, usage counters, page versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioq.operators import graph, lint, names
from folioq.store import checkpoints, stored

QUEUE_CAP = 50
REPEATEDLY = 3
HUB_LINKS = 5
MOST_SKIPPED = 10
SCANNED_COMMITS = 2000
DAY = 24 * 60 * 60
#: Kinds of work in their order, with their priorities and actions (pairs of pages that a merge does not suit get PAIR_CHECK).
KINDS = {
    "duplicate-candidate": (1, "merge"),
    "broken-link": (1, "fix-link"),
    "broken-source": (1, "fix-link"),
    "summary-stale": (2, "update-summary"),
    "missing-summary": (2, "write-summary"),
    "decay-candidate": (3, "archive-or-supersede"),
    "orphan": (3, "review-or-archive"),
}
PAIR_CHECK = "check-or-distinct"
#: What items of the queue say.
SAYS = {
    "broken-link": "links to missing page(s): %s",
    "broken-source": "sources entry '%s' has no page",
    "summary-stale": "the body changed since the summary was written",
    "missing-summary": "%s pages link here, but it has no summary",
    "decay-candidate": "never read on this machine, no page links here, unchanged for more than 90 days",
    "orphan": "no other page links here and it is unchanged for more than 90 days",
}
IN_A_TASK = 1_000_000
QUEUE_HOURS = 1
FORGET_AFTER_DAYS = 30


def skip_counts(log: DataFrame) -> DataFrame:
    """log: (kind, pages, outcome, seq). Rows (kind, pages, skipped): skips and deferrals since the last time it was done."""
    key = ["kind", "pages"]
    last = log.groupBy(*key).agg(F.max(F.when(F.col("outcome") == "done", F.col("seq"))).alias("done_at"))
    since = log.join(last, key).where(F.col("outcome").isin("skipped", "deferred") & (F.col("done_at").isNull() | (F.col("seq") > F.col("done_at"))))
    return since.groupBy(*key).agg(F.count("*").alias("skipped"))


def log_stats(log: DataFrame) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return log.groupBy("kind").agg(count("done"), count("skipped"), count("deferred"), F.count("*").alias("total")).orderBy(F.desc("total"), "kind")


def most_skipped(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("skipped"), "kind", "pages").limit(MOST_SKIPPED)


def _in_order(rows: pa.Table) -> pa.Table:
    """Those of some pairs that are taken one after another."""
    rows = rows.sort_by([(c, "ascending") for c in ("seq", "a", "b")])
    met, taken = set(), []
    for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True):
        taken.append(a not in met and b not in met)
        if taken[-1]:
            met |= {a, b}
    return rows.filter(pa.array(taken, pa.bool_()))


def _chosen_pairs(pairs: DataFrame, in_a_task: int = IN_A_TASK) -> DataFrame:
    """pairs: (a, b, seq, ...). Those that are taken one after another in order of seq, a, b, each only if neither of its pages has been.

    Up to in_a_task pairs are settled in one task. Of more, those that hang together by pages are settled together, several
    such components in a task; of a component that is itself larger, the first in_a_task pairs, which depend on no later one, are settled
    first, pairs that meet a taken one go, and so on.
    """
    pairs = stored(pairs, "pairs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    n = pairs.count()
    if n <= in_a_task:
        return stored(pairs.groupBy(F.lit(0).alias("all")).applyInArrow(_in_order, schema), "taken")
    checkpoints(pairs.sparkSession)
    component = graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "a")
    pairs = stored(pairs.join(component, "a").select(*pairs.columns, "component"), "pairs")
    sizes = pairs.groupBy("component").agg(F.count("*").alias("n"))
    giant = sizes.where(F.col("n") > in_a_task).select("component")
    part = F.pmod(F.xxhash64("component"), F.lit(-(-n // in_a_task) * 2))
    small = pairs.join(giant, "component", "left_anti").withColumn("part", part)
    settled = lambda rows: _in_order(rows.drop_columns(["component", "part"]))
    taken = stored(small.groupBy("part").applyInArrow(settled, schema), "taken")
    left = stored(pairs.join(giant, "component", "left_semi").drop("component"), "pairs")
    while not left.isEmpty():
        first = left.orderBy("seq", "a", "b").limit(in_a_task)
        now = stored(first.groupBy(F.lit(0).alias("all")).applyInArrow(_in_order, schema), "taken")
        taken = taken.unionByName(now)
        gone = now.select(F.explode(F.array("a", "b")).alias("page"))
        left = stored(left.join(gone.withColumnRenamed("page", "a"), "a", "left_anti").join(gone.withColumnRenamed("page", "b"), "b", "left_anti").select(*now.columns), "pairs")
    return taken


def work_queue(candidates: DataFrame, skips: DataFrame, cap: int = QUEUE_CAP) -> DataFrame:
    """candidates: (kind, pages: array of one or, for pairs, two in order, action or null, reason, seq). The queue with a place for each item.

    A page is in one item at most, that of the highest rank; only pairs and links to fix never hide each other.
    Items that were skipped often go last within priority 3 and say so. omitted tells how many items the cap left out.
    """
    names = list(KINDS)
    at = lambda v: F.create_map(*[x for k in names for x in (F.lit(k), F.lit(v(k)))])[F.col("kind")]
    known = candidates.where(F.col("kind").isin(*names)).withColumns({"priority": at(lambda k: KINDS[k][0]), "kind_order": at(names.index), "action": F.coalesce("action", at(lambda k: KINDS[k][1]))})
    known = known.withColumn("key", F.array_join("pages", ","))
    skipped = skips.select("kind", F.col("pages").alias("key"), "skipped")
    seen = known.join(skipped, ["kind", "key"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))
    advice = F.when(F.col("kind").isin("orphan", "decay-candidate"), "decide or mark keep").otherwise("decide it")
    again = F.concat(F.col("reason"), F.lit(" (skipped "), F.col("skipped").cast("string"), F.lit("× before — "), advice, F.lit(")"))
    seen = stored(seen.withColumn("reason", F.when(F.col("skipped") >= REPEATEDLY, again).otherwise(F.col("reason"))), "candidates")
    columns = ["priority", "kind_order", "seq", "kind", "pages", "action", "reason", "skipped"]
    pairs = seen.where("size(pages) = 2").withColumns({"a": F.get("pages", F.lit(0)), "b": F.get("pages", F.lit(1))})
    pairs = _chosen_pairs(pairs.select("a", "b", *columns))
    single = seen.where("size(pages) = 1").withColumn("page", F.get("pages", F.lit(0)))
    first = Window.partitionBy("page").orderBy("kind_order", "seq")
    of = lambda rows: rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    fixes = of(single.where("action = 'fix-link'"))
    covered = pairs.select(F.explode("pages").alias("page")).unionByName(fixes.select("page"))
    others = of(single.where("action <> 'fix-link'").join(covered, "page", "left_anti"))
    out = pairs.select(*columns).unionByName(fixes.select(*columns)).unionByName(others.select(*columns))
    out = stored(out.withColumn("late", ((F.col("priority") == 3) & (F.col("skipped") >= REPEATEDLY)).cast("int")), "queue")
    order = ["priority", "late", "kind_order", "seq", "pages"]
    top = out.orderBy(*order).limit(cap)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most cap rows
    total = out.agg(F.count("*").alias("total"))
    return placed.join(F.broadcast(total)).select("place", "priority", "kind", "pages", "action", "reason", "skipped", F.greatest(F.lit(0), F.col("total") - cap).alias("omitted"))


def queue_item(rows: DataFrame, kind: str, detail: Column | None = None, seq: Column | None = None) -> DataFrame:
    """rows: (id). Candidates of one kind for the queue, one for each row."""
    reason = F.lit(SAYS[kind]) if detail is None else F.replace(F.lit(SAYS[kind]), F.lit("%s"), detail.cast("string"))
    return rows.select(F.lit(kind).alias("kind"), F.array("id").alias("pages"), F.lit(None).cast("string").alias("action"), reason.alias("reason"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"))


def candidates(pages: DataFrame, access: DataFrame, now: int, pairs: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """What there is to do on the pages of a vault, for work_queue: candidates of all seven kinds.

    pages: as vault.read_pages gives them; access: (page_id, reads); pairs: (a, b, similarity, by_title, suggestion) as names.ranked_pairs gives
    them, unset: pages of one title; index: (id, summary_body_hash, body_hash) of the recorded summaries, unset: none are recorded, so nothing is said of summaries.
    """
    edges = graph.raw_edges(pages)
    inbound = graph.inbound(edges)
    if pairs is None:
        titles, _ = names.title_pairs(pages)
        none = pages.sparkSession.createDataFrame([], "id string, type string, embedding array<double>")
        pairs = names.ranked_pairs(titles, names.content_pairs(none)[0], none)
    why = F.concat_ws(", ", F.when(F.col("by_title"), F.lit("same title")), F.concat(F.lit("similarity "), F.format_number("similarity", 2)))
    order = F.round((1 - F.coalesce("similarity", F.lit(-2.0))) * 1_000_000).cast("long")
    parts = [pairs.select(F.lit("duplicate-candidate").alias("kind"), F.array("a", "b").alias("pages"), F.when(F.col("suggestion") == PAIR_CHECK, PAIR_CHECK).alias("action"), why.alias("reason"), order.alias("seq"))]
    broken = graph.broken_by_source(graph.index_edges(pages)).withColumnRenamed("src", "id")
    parts.append(queue_item(broken, "broken-link", F.col("targets")))
    sources = pages.select("id", F.posexplode("sources").alias("at", "to")).join(pages.select(F.col("id").alias("to")), "to", "left_anti")
    parts.append(queue_item(sources, "broken-source", F.col("to"), F.col("at")))
    if index is not None:
        work = summary_work(pages.select("id", "summary").join(index, "id"), inbound).withColumnRenamed("page", "id")
        parts.append(queue_item(work.where("kind = 'summary-stale'"), "summary-stale"))
        parts.append(queue_item(work.where("kind = 'missing-summary'"), "missing-summary", F.col("inbound")))
    parts.append(queue_item(decayed(pages, access, inbound.select("id"), now), "decay-candidate"))
    parts.append(queue_item(lint.orphans(pages, edges, now), "orphan"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def queue_is_fresh(generated_at: str, now: str, hours: int = QUEUE_HOURS) -> bool:
    """Whether a stored queue may still be shown; times as ISO text."""
    from datetime import datetime, timedelta

    age = datetime.fromisoformat(now) - datetime.fromisoformat(generated_at)
    return timedelta(0) <= age < timedelta(hours=hours)


def cached_queue(spark, folder: str, now: str, build) -> DataFrame:
    """The queue stored in folder while it is fresh, else build(), stored with its time."""
    try:
        found = spark.read.parquet(folder)
        made = found.agg(F.max("generated_at")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        made = None
    if made is None or not queue_is_fresh(made, now):
        build().withColumn("generated_at", F.lit(now)).write.mode("overwrite").parquet(folder)
        found = spark.read.parquet(folder)
    return found


def summary_work(pages: DataFrame, inbound: DataFrame, hub_links: int = HUB_LINKS) -> DataFrame:
    """Rows (kind, page, inbound): summaries that lag behind their body, and much-linked pages without one. Only for an index that has recorded summaries."""
    rows = pages.join(inbound, "id", "left")
    blank = F.coalesce(F.trim("summary"), F.lit("")) == ""
    stale = ~blank & (F.coalesce("summary_body_hash", F.lit("")) != F.col("body_hash"))
    hub = blank & (F.coalesce("inbound", F.lit(0)) >= hub_links)
    kind = F.when(stale, "summary-stale").when(hub, "missing-summary")
    return rows.select(kind.alias("kind"), F.col("id").alias("page"), F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound")).where("kind is not null")


def decayed(pages: DataFrame, access: DataFrame, inbound: DataFrame, now: int) -> DataFrame:
    """Never read, never linked, old and not kept."""
    rows = pages.join(access.select(F.col("page_id").alias("id"), "reads"), "id", "left").join(inbound, "id", "left_anti")
    return rows.where((F.coalesce("reads", F.lit(0)) == 0) & (F.col("file_mtime") > 0) & (F.col("file_mtime") < now - 90 * DAY) & ~F.coalesce("keep", F.lit(False))).select("id")


def access_counts(events: DataFrame) -> DataFrame:
    """events: (page_id, kind read|hit, ts). Rows (page_id, reads, search_hits, last_read_at)."""
    read = F.col("kind") == "read"
    return events.where(F.col("kind").isin("read", "hit")).groupBy("page_id").agg(F.count_if(read).alias("reads"), F.count_if(~read).alias("search_hits"), F.max(F.when(read, F.col("ts"))).alias("last_read_at"))


def remembered(events: DataFrame, now, days: int = FORGET_AFTER_DAYS) -> DataFrame:
    """events: (page_id, kind read or hit, ts). Counters of the pages used in the days before now, each since it was last unused for as many days."""
    read = F.col("kind") == "read"
    runs = events.where(F.col("kind").isin("read", "hit")).groupBy("page_id", F.session_window("ts", f"{days} days").alias("w"))
    runs = runs.agg(F.count_if(read).alias("reads"), F.count_if(~read).alias("search_hits"), F.max(F.when(read, F.col("ts"))).alias("last_read_at"))
    # The end is compared after the last run is chosen: a condition on the window itself would go below the merging of its events.
    last = runs.groupBy("page_id").agg(F.max_by(F.struct("reads", "search_hits", "last_read_at"), "w.end").alias("last"), F.max("w.end").alias("end"))
    return last.where(F.col("end") > now).select("page_id", "last.*")


def carried(access: DataFrame, old: str, new: str) -> DataFrame:
    """Counters of a renamed page added to those of its new name."""
    return access.withColumn("page_id", F.when(F.col("page_id") == old, new).otherwise(F.col("page_id"))).groupBy("page_id").agg(F.sum("reads").alias("reads"), F.sum("search_hits").alias("search_hits"), F.max("last_read_at").alias("last_read_at"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Rows (key, started, ended, events): runs of events at most gap apart."""
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return grouped.select(key, "started", "ended", "events")


def changed(pages: DataFrame, index: DataFrame) -> DataFrame:
    """pages: (id, text); index: (id, file_hash). Rows (id, file_hash, state): new, changed, unchanged or gone."""
    now = pages.select("id", F.sha2("text", 256).alias("new_hash"))
    both = now.join(index.select("id", "file_hash"), "id", "full")
    state = F.when(F.col("file_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("file_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return both.select("id", F.coalesce("new_hash", "file_hash").alias("file_hash"), state.alias("state"))


def unchanged(pages: DataFrame, index: DataFrame, chunks: DataFrame) -> DataFrame:
    """pages: (id, file_hash, summary); index: the same with summary_indexed_hash; chunks: (page_id). Rows (id, unchanged).

    A page is unchanged if its file's hash is the indexed one, its summary was indexed from that file and is the same, and it has a chunk.
    """
    n = chunks.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    old = index.select("id", F.col("file_hash").alias("old_hash"), "summary_indexed_hash", F.col("summary").alias("old_summary"))
    met = pages.join(old, "id", "left").join(n, "id", "left")
    same = (F.col("old_hash") == F.col("file_hash")) & (F.col("summary_indexed_hash") == F.col("file_hash")) & (F.col("n_chunks") > 0)
    return met.select("id", (F.coalesce(same, F.lit(False)) & F.col("old_summary").eqNullSafe(F.col("summary"))).alias("unchanged"))


def index_counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (pages, chunks)."""
    return pages.agg(F.count("*").alias("pages")).join(chunks.agg(F.count("*").alias("chunks")))


def without_gone(access: DataFrame, pages: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Counters without those of pages that are gone and were not read for days."""
    here = pages.select(F.col("id").alias("page_id"), F.lit(True).alias("here")).distinct()
    kept = F.col("here").isNotNull() | (F.coalesce(F.unix_timestamp("last_read_at"), F.lit(0)) >= now - days * DAY)
    return access.join(here, "page_id", "left").where(kept).drop("here")


def counter_events(hits: DataFrame, read_ids: DataFrame, ts) -> DataFrame:
    """What a use of pages counts: a hit for each of the first ten of a search, a read for each page found, once. Rows (page_id, kind, ts)."""
    first = hits.where("place <= 10").select(F.col("id").alias("page_id"), F.lit("hit").alias("kind"))
    read = read_ids.select(F.col("id").alias("page_id")).distinct().withColumn("kind", F.lit("read"))
    return first.unionByName(read).withColumn("ts", ts)


def page_history(deltas: DataFrame, commits: DataFrame, path: str, limit: int) -> DataFrame:
    """The newest commits that touch a path, of the newest that are looked through."""
    recent = commits.orderBy(F.desc("ts"), "sha").limit(SCANNED_COMMITS)
    return recent.join(deltas.where(F.col("path") == path).select("sha").distinct(), "sha", "left_semi").orderBy(F.desc("ts"), "sha").limit(limit)


def commit_changes(deltas: DataFrame) -> DataFrame:
    """deltas: (sha, path, status A, M, D, R or C, added, removed). Rows of one commit each."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return deltas.groupBy("sha").agg(F.count("*").alias("files_changed"), *map(status, "AMDRC"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
