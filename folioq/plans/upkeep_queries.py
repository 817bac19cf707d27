"""Work queue, log, counters, sessions, change detection, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioq.operators import chunks, line_diff, refactor, upkeep, versions
from folioq.plans.register import registry
from folioq.plans.tables import ACCESS, NOW, PAGES, WORK_LOG, access_events, pages, table, work_log

QUERIES, ORACLES, query = registry()

_SKIPS = f"""{WORK_LOG}, done AS (SELECT kind, pages, max(seq) AS done_at FROM work_log WHERE outcome = 'done' GROUP BY ALL),
skips AS (SELECT kind, pages, count(*) AS skipped FROM work_log l LEFT JOIN done d USING (kind, pages) WHERE outcome <> 'done' AND (done_at IS NULL OR seq > done_at) GROUP BY ALL)"""


@query(f"WITH {_SKIPS} SELECT * FROM skips")
def skip_counts(spark, sf_dir):
    return upkeep.skip_counts(work_log(spark, sf_dir))


@query(f"WITH {_SKIPS} SELECT * FROM skips ORDER BY skipped DESC, kind, pages LIMIT 10")
def most_skipped(spark, sf_dir):
    return upkeep.most_skipped(upkeep.skip_counts(work_log(spark, sf_dir)))


@query(f"""WITH {WORK_LOG} SELECT kind, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'skipped') AS skipped,
count(*) FILTER (outcome = 'deferred') AS deferred, count(*) AS total FROM work_log GROUP BY kind""")
def log_stats(spark, sf_dir):
    return upkeep.log_stats(work_log(spark, sf_dir))


_INBOUND = "inbound AS (SELECT cited AS id, count(DISTINCT id) AS n FROM pages WHERE id <> cited GROUP BY cited)"
_CANDIDATES = f"""{PAGES}, {ACCESS}, {_INBOUND},
numbered AS (SELECT *, split_part(id, '/', 2)::BIGINT AS d FROM pages),
copies AS (SELECT d, lead(d) OVER (PARTITION BY md5(body) ORDER BY d) AS next FROM numbered WHERE body IS NOT NULL),
old AS (SELECT * FROM numbered WHERE epoch(CAST(updated_at AS DATE))::BIGINT < {NOW} - 7776000 AND id NOT IN (SELECT id FROM inbound)),
candidates AS (
  SELECT 'duplicate-candidate' AS kind, [d, next] AS ds, CASE WHEN d % 2 = 0 THEN 'check-or-distinct' END AS action, 'same text' AS reason, d AS seq FROM copies WHERE next IS NOT NULL
  UNION ALL SELECT 'broken-link', [d], NULL, 'links to missing page(s): ' || superseded_by, d FROM numbered WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM pages)
  UNION ALL SELECT 'broken-source', [d], NULL, 'sources entry ' || chr(39) || cited || chr(39) || ' has no page', d FROM (SELECT d, CASE WHEN d % 3 = 0 THEN cited ELSE id END AS cited FROM numbered) WHERE cited NOT IN (SELECT id FROM pages)
  UNION ALL SELECT 'summary-stale', [d], NULL, 'the body changed since the summary was written', d FROM numbered WHERE trim(coalesce(summary, '')) <> '' AND sha256(body) <> CASE WHEN d % 4 = 0 THEN sha256(summary) ELSE sha256(body) END
  UNION ALL SELECT 'missing-summary', [d], NULL, n || ' pages link here, but it has no summary', d FROM numbered JOIN inbound USING (id) WHERE trim(coalesce(summary, '')) = ''
  UNION ALL SELECT 'decay-candidate', [d], NULL, '{upkeep.SAYS["decay-candidate"]}', d FROM old LEFT JOIN access ON page_id = id WHERE coalesce(reads, 0) = 0
  UNION ALL SELECT 'orphan', [d], NULL, '{upkeep.SAYS["orphan"]}', d FROM old)"""


def _candidates(spark, sf_dir):
    """Work of all seven kinds on documents: neighbouring copies, lost successors and sources (every third page cites another, the rest themselves), summaries (every fourth is older than its body), and pages without links."""
    rows = pages(spark, sf_dir).withColumn("d", F.substring_index("id", "/", -1).cast("long"))
    ids = rows.select("id")
    inbound = rows.select(F.col("id").alias("src"), F.explode("sources").alias("id")).where("src <> id").distinct().groupBy("id").agg(F.count("*").alias("inbound"))
    copies = rows.where("body is not null").select("d", "id", F.md5("body").alias("h")).withColumn("next", F.lead("id").over(Window.partitionBy("h").orderBy("d")))

    lost = lambda df, c: df.where(F.col(c).isNotNull()).join(ids.withColumnRenamed("id", c), c, "left_anti")
    cited = rows.withColumn("cited", F.when(F.col("d") % 3 == 0, F.get("sources", F.lit(0))).otherwise(F.col("id")))
    body = F.sha2("body", 256)
    hashed = rows.select("id", "summary", body.alias("body_hash"), F.when(F.col("d") % 4 == 0, F.sha2(F.coalesce("summary", F.lit("")), 256)).otherwise(body).alias("summary_body_hash"))
    summaries = upkeep.summary_work(hashed, inbound, hub_links=1).withColumnRenamed("page", "id").withColumn("d", F.substring_index("id", "/", -1).cast("long"))
    old = rows.where(F.unix_timestamp(F.to_timestamp("updated_at")) < NOW - 90 * upkeep.DAY).join(inbound, "id", "left_anti")
    unread = old.join(upkeep.access_counts(access_events(spark, sf_dir)).where("reads > 0").select(F.col("page_id").alias("id")), "id", "left_anti")
    pairs = copies.where("next is not null").select(F.lit("duplicate-candidate").alias("kind"), F.array("id", "next").alias("pages"), F.when(F.col("d") % 2 == 0, upkeep.PAIR_CHECK).alias("action"), F.lit("same text").alias("reason"), F.col("d").alias("seq"))
    item = lambda df, kind, detail=None: upkeep.queue_item(df, kind, detail, F.col("d"))
    parts = [
        pairs,
        item(lost(rows, "superseded_by"), "broken-link", F.col("superseded_by")),
        item(lost(cited, "cited"), "broken-source", F.col("cited")),
        item(summaries.where("kind = 'summary-stale'"), "summary-stale"),
        item(summaries.where("kind = 'missing-summary'"), "missing-summary", F.col("inbound")),
        item(unread, "decay-candidate"),
        item(old, "orphan"),
    ]
    return reduce(DataFrame.unionByName, parts)


_QUEUE = f"""WITH {_SKIPS}, {_CANDIDATES},
named AS (SELECT *, list_transform(ds, lambda d: 'documents/' || d) AS pages_, array_to_string(list_transform(ds, lambda d: 'documents/' || d), ',') AS key FROM candidates),
ranked AS (
  SELECT c.kind, c.pages_, c.ds, c.seq, coalesce(skipped, 0) AS skipped, CASE c.kind WHEN 'duplicate-candidate' THEN 0 WHEN 'broken-link' THEN 1 WHEN 'broken-source' THEN 2 WHEN 'summary-stale' THEN 3 WHEN 'missing-summary' THEN 4 WHEN 'decay-candidate' THEN 5 ELSE 6 END AS kind_order,
    coalesce(action, CASE c.kind WHEN 'duplicate-candidate' THEN 'merge' WHEN 'summary-stale' THEN 'update-summary' WHEN 'missing-summary' THEN 'write-summary' WHEN 'decay-candidate' THEN 'archive-or-supersede' WHEN 'orphan' THEN 'review-or-archive' ELSE 'fix-link' END) AS action,
    reason || CASE WHEN coalesce(skipped, 0) >= 3 THEN ' (skipped ' || skipped || '× before — ' || CASE WHEN c.kind IN ('orphan', 'decay-candidate') THEN 'decide or mark keep' ELSE 'decide it' END || ')' ELSE '' END AS reason
  FROM named c LEFT JOIN skips s ON s.kind = c.kind AND s.pages = c.key),
chains AS (SELECT *, row_number() OVER (PARTITION BY md5(p.body) ORDER BY r.ds[1]) AS n FROM ranked r JOIN pages p ON p.id = r.pages_[1] WHERE len(ds) = 2),
pairs AS (SELECT kind, pages_, ds, seq, skipped, kind_order, action, reason FROM chains WHERE n % 2 = 1),
fixes AS (SELECT * FROM ranked WHERE action = 'fix-link' QUALIFY row_number() OVER (PARTITION BY pages_ ORDER BY kind_order, seq) = 1),
covered AS (SELECT unnest(pages_) AS page FROM pairs UNION SELECT pages_[1] FROM fixes),
others AS (SELECT * FROM ranked WHERE len(ds) = 1 AND action <> 'fix-link' AND pages_[1] NOT IN (SELECT page FROM covered) QUALIFY row_number() OVER (PARTITION BY pages_ ORDER BY kind_order, seq) = 1),
items AS (SELECT * FROM pairs UNION ALL SELECT * FROM fixes UNION ALL SELECT * FROM others),
placed AS (SELECT *, CASE WHEN kind_order < 3 THEN 1 WHEN kind_order < 5 THEN 2 ELSE 3 END AS priority, CASE WHEN kind_order >= 5 AND skipped >= 3 THEN 1 ELSE 0 END AS late FROM items)
SELECT (row_number() OVER (ORDER BY priority, late, kind_order, seq, pages_))::INTEGER AS place, priority, kind, array_to_string(pages_, ',') AS pages, action, reason, skipped, greatest(0, count(*) OVER () - CAP) AS omitted FROM placed QUALIFY place <= CAP"""


def _queue(spark, sf_dir, cap):
    out = upkeep.work_queue(_candidates(spark, sf_dir), upkeep.skip_counts(work_log(spark, sf_dir)), cap)
    return out.withColumn("pages", F.array_join("pages", ","))


@query(_QUEUE.replace("CAP", "50"))
def work_queue(spark, sf_dir):
    return _queue(spark, sf_dir, upkeep.QUEUE_CAP)


@query(_QUEUE.replace("CAP", "10000000"))
def work_queue_whole(spark, sf_dir):
    """The queue with a cap above its length: items of every kind."""
    return _queue(spark, sf_dir, 10_000_000)


@query(f"WITH {ACCESS} SELECT page_id, reads, search_hits, last_read_at FROM access")
def access_counts(spark, sf_dir):
    return upkeep.access_counts(access_events(spark, sf_dir))


@query("""WITH e AS (SELECT 'documents/' || user_id AS page_id, event_type, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 DAY THEN 1 ELSE 0 END AS new FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM e),
last AS (SELECT page_id, n, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'click') AS search_hits, max(ts) FILTER (event_type = 'view') AS last_read_at, max(ts) AS used FROM runs GROUP BY page_id, n),
newest AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1)
SELECT page_id, reads, search_hits, last_read_at FROM newest WHERE used + INTERVAL 2 DAY > (SELECT max(ts) FROM events)""")
def access_remembered(spark, sf_dir):
    """Counters of pages used in the last two days, each since it was last unused for two days."""
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return upkeep.remembered(access_events(spark, sf_dir), F.lit(now), 2)


@query(f"""WITH {ACCESS} SELECT CASE WHEN page_id = 'documents/1' THEN 'documents/2' ELSE page_id END AS page_id, sum(reads)::BIGINT AS reads, sum(search_hits)::BIGINT AS search_hits, max(last_read_at) AS last_read_at FROM access GROUP BY 1""")
def access_carried(spark, sf_dir):
    return upkeep.carried(upkeep.access_counts(access_events(spark, sf_dir)), "documents/1", "documents/2")


@query(f"""WITH {PAGES}, {ACCESS}, linked AS (SELECT DISTINCT cited FROM pages WHERE id <> cited)
SELECT id FROM pages LEFT JOIN access ON page_id = id WHERE coalesce(reads, 0) = 0 AND id NOT IN (SELECT cited FROM linked)
AND epoch(CAST(updated_at AS DATE))::BIGINT < {NOW} - 7776000""")
def decayed_pages(spark, sf_dir):
    rows = pages(spark, sf_dir).select("id", "sources", F.unix_timestamp(F.to_timestamp("updated_at")).alias("file_mtime"), F.lit(False).alias("keep"))
    linked = rows.select(F.col("id").alias("src"), F.explode("sources").alias("id")).where("src <> id").select("id").distinct()
    return upkeep.decayed(rows, upkeep.access_counts(access_events(spark, sf_dir)), linked, NOW)


@query(f"""WITH {PAGES}, inbound AS (SELECT cited AS id, count(DISTINCT id) AS n FROM pages WHERE id <> cited GROUP BY cited)
SELECT CASE WHEN summary IS NOT NULL AND trim(summary) <> '' THEN 'summary-stale' ELSE 'missing-summary' END AS kind, p.id AS page, coalesce(n, 0) AS inbound FROM pages p LEFT JOIN inbound i USING (id)
WHERE (trim(coalesce(summary, '')) <> '' AND sha256(body) <> sha256(summary)) OR (trim(coalesce(summary, '')) = '' AND coalesce(n, 0) >= 5)""")
def summary_work(spark, sf_dir):
    """A summary is up to date here if it is all of the body."""
    rows = pages(spark, sf_dir)
    inbound = rows.select(F.col("id").alias("src"), F.explode("sources").alias("id")).where("src <> id").distinct().groupBy("id").agg(F.count("*").alias("inbound"))
    hashed = rows.select("id", "summary", F.sha2("body", 256).alias("body_hash"), F.sha2(F.coalesce("summary", F.lit("")), 256).alias("summary_body_hash"))
    return upkeep.summary_work(hashed, inbound)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, n""")
def change_sessions(spark, sf_dir):
    return upkeep.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour")


_OLD_INDEX = "o AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS id, CASE WHEN doc_id % 4 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS old_hash FROM documents WHERE doc_id % 3 <> 0)"


@query(f"""WITH {_OLD_INDEX} SELECT coalesce(d.doc_id, o.id) AS id, coalesce(sha256(d.text), old_hash) AS file_hash,
CASE WHEN o.id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'gone' WHEN sha256(d.text) = old_hash THEN 'unchanged' ELSE 'changed' END AS state FROM documents d FULL JOIN o ON o.id = d.doc_id""")
def hash_changes(spark, sf_dir):
    """What is new, changed, unchanged or gone against an index that lacks every third document, has old texts of every fourth and pages that no document is."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    old_id = F.when(F.col("id") % 5 == 0, -F.col("id") - 1).otherwise(F.col("id"))
    index = docs.where("id % 3 <> 0").select(old_id.alias("id"), F.when(F.col("id") % 4 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("file_hash"))
    return upkeep.changed(docs, index)


@query("""WITH c AS (SELECT vec_id // 3 AS id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT doc_id AS id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND coalesce(n, 0) > 0 AS unchanged FROM documents LEFT JOIN c ON c.id = doc_id""")
def index_unchanged(spark, sf_dir):
    """Pages that need no new index: hash, summary's hash, summary and chunks as before."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"), F.lit("s").alias("summary"))
    changed = lambda n, c, v: F.when(F.col("id") % n == 0, v).otherwise(F.col(c))
    index = docs.where("id % 3 <> 0").select("id", changed(4, "file_hash", F.lit("old")).alias("file_hash"), changed(7, "file_hash", F.lit(None)).alias("summary_indexed_hash"), changed(5, "summary", F.lit(None)).alias("summary"))
    return upkeep.unchanged(docs, index, table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("page_id")))


@query("SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM embeddings) AS chunks")
def index_counts(spark, sf_dir):
    return upkeep.index_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


@query(f"""WITH {ACCESS}, now AS (SELECT max(epoch(ts))::BIGINT AS t FROM events) SELECT page_id, reads, search_hits, last_read_at FROM access, now
WHERE split_part(page_id, '/', 2)::BIGINT % 2 = 0 OR epoch(date_trunc('second', coalesce(last_read_at, TIMESTAMP '1970-01-01'))) >= t - 2592000""")
def access_without_gone(spark, sf_dir):
    """Counters of pages that are here (even numbers) or were read in the last 30 days."""
    counts = upkeep.access_counts(access_events(spark, sf_dir))
    here = counts.select(F.col("page_id").alias("id")).where(F.substring_index("page_id", "/", -1).cast("long") % 2 == 0)
    now = table(spark, sf_dir, "events").agg(F.max(F.unix_timestamp("ts"))).first()[0] or 0
    return upkeep.without_gone(counts, here, now)


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prune_missing(spark, sf_dir):
    """Index rows without a page (labels stand for the pages that are left)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


def _versions(spark, sf_dir):
    """Turns of conversations as versions: a conversation is a commit's page."""
    t = table(spark, sf_dir, "conversations")
    sha = F.md5(F.concat_ws(":", "conv_id", "turn"))
    return t.select(sha.alias("sha"), F.col("turn").alias("ts"), F.concat(F.lit("p"), F.pmod("conv_id", F.lit(50)).cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, "AMDRC")), (F.pmod("turn", F.lit(5)) + 1).cast("int")).alias("status"), F.length("text").alias("added"), F.pmod("conv_id", F.lit(9)).alias("removed"))


@query("""SELECT md5(conv_id || ':' || turn) AS sha, count(*) AS files_changed, count(*) FILTER (turn % 5 = 0) AS n_a, count(*) FILTER (turn % 5 = 1) AS n_m, count(*) FILTER (turn % 5 = 2) AS n_d,
count(*) FILTER (turn % 5 = 3) AS n_r, count(*) FILTER (turn % 5 = 4) AS n_c, sum(length(text))::BIGINT AS added, sum(conv_id % 9)::BIGINT AS removed FROM conversations GROUP BY conv_id, turn""")
def commit_changes(spark, sf_dir):
    return upkeep.commit_changes(_versions(spark, sf_dir))


@query("""WITH c AS (SELECT DISTINCT md5(conv_id || ':' || turn) AS sha, turn AS ts FROM conversations), recent AS (SELECT * FROM c ORDER BY ts DESC, sha LIMIT 2000)
SELECT sha, ts FROM recent WHERE sha IN (SELECT md5(conv_id || ':' || turn) FROM conversations WHERE conv_id % 50 = 3) ORDER BY ts DESC, sha LIMIT 20""")
def page_history(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    return upkeep.page_history(versions, versions.select("sha", "ts").distinct(), "p3", 20)


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 = 1 THEN md5(text || 't') WHEN doc_id % 3 = 1 THEN md5(text || 'o') ELSE md5(text) END AS hash,
CASE WHEN doc_id % 12 = 1 THEN 'conflict' WHEN doc_id % 4 = 1 THEN 'theirs' WHEN doc_id % 3 = 1 THEN 'ours' ELSE 'same' END AS state FROM documents WHERE doc_id % 12 <> 1
UNION ALL SELECT doc_id::VARCHAR, NULL, 'conflict' FROM documents WHERE doc_id % 12 = 1""")
def merged_trees(spark, sf_dir):
    """Three trees of documents: every third changed on one side, every fourth on the other."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("doc_id").cast("string").alias("path"), "text")
    tree = lambda n, mark: d.select("path", F.md5(F.when(F.col("d") % n == 1, F.concat("text", F.lit(mark))).otherwise(F.col("text"))).alias("hash"))
    return versions.merged_trees(d.select("path", F.md5("text").alias("hash")), tree(3, "o"), tree(4, "t"))


@query("""WITH v AS (SELECT (conv_id % 50)::VARCHAR AS path, md5(conv_id || ':' || turn) AS sha, turn AS ts, text FROM conversations WHERE turn <= 3)
SELECT path, sha, ts, text FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC) = 1""")
def versions_as_of(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    every = t.select(F.pmod("conv_id", F.lit(50)).cast("string").alias("path"), F.md5(F.concat_ws(":", "conv_id", "turn")).alias("sha"), F.col("turn").alias("ts"), "text")
    return versions.as_of(every, 3)


@query("""SELECT CASE user_id % 3 WHEN 0 THEN 'orphan' WHEN 1 THEN 'decay-candidate' ELSE 'broken-source' END AS kind, 'documents/' || user_id AS pages,
CASE event_type WHEN 'error' THEN 'done' WHEN 'view' THEN 'skipped' ELSE 'deferred' END AS outcome, props AS note, event_id AS seq FROM events WHERE event_type IN ('error', 'view', 'click')""")
def log_items(spark, sf_dir):
    """Outcomes written as lines of a log and read back."""
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("note"))
    rows = work_log(spark, sf_dir).join(notes, "seq")
    lines = rows.select("seq", versions.log_line(F.col("outcome"), F.col("kind"), F.array("pages"), F.col("note")).alias("line"))
    return versions.log_items(lines)


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '| [a](entities/' || doc_id || '.md) |' ELSE '[[entities/' || doc_id || '|a]] `[b](topics/x)` ' || source END AS body FROM documents""")
def links_normalised(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    table_row = F.concat(F.lit("| [a](entities/"), d, F.lit(".md) |"))
    prose = F.concat(F.lit("[a](entities/"), d, F.lit(".md) `[b](topics/x)` "), F.col("source"))
    body = F.when(F.col("doc_id") % 2 == 0, table_row).otherwise(prose)
    return table(spark, sf_dir, "documents").select("doc_id", refactor.wiki_links(body).alias("body"))


@query()
def section_chunks(spark, sf_dir):
    """Texts under a heading each, cut into sections and windows; rows only."""
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text"))
    return chunks.section_chunks(table(spark, sf_dir, "documents").withColumn("body", body), "doc_id")


@query("""SELECT doc_id AS id, source AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def integrity_missing(spark, sf_dir):
    """Indexed rows (documents) without a file (a label)."""
    index = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("path"), "source")
    lost = versions.not_on_disk(index, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")))
    return lost.join(index.select("id", "source"), "id").select("id", F.col("source").alias("path"))


@query(r"""WITH v AS (SELECT conv_id || '/' || turn AS path, conv_id % 5 AS k, string_split(text, chr(10)) AS l, text FROM conversations WHERE text <> ''),
c AS (SELECT *, len(l) AS n FROM v)
SELECT path, CASE k WHEN 0 THEN NULL ELSE path END AS old_path, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE 'M' END AS status,
       (CASE k WHEN 0 THEN n WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS added, (CASE k WHEN 1 THEN n WHEN 0 THEN 0 WHEN 2 THEN 0 ELSE 1 END)::BIGINT AS removed FROM c WHERE k < 4""")
def version_lines(spark, sf_dir):
    """Added and removed lines of two versions of conversations' turns: some are new, some gone, some have two lines more at their ends, some another first line, some are as before."""
    turns = table(spark, sf_dir, "conversations").where("text <> ''").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.pmod("conv_id", F.lit(5)).alias("k"), "text")
    name = F.concat(F.lit("«"), F.col("path"), F.lit("»"))
    first = F.concat(name, F.when(F.instr("text", "\n") > 0, F.regexp_replace("text", r"^[^\n]*", "")).otherwise(""))
    later = F.when(F.col("k") == 2, F.concat(name, F.lit("\n"), F.col("text"), F.lit("\n"), name)).when(F.col("k") == 3, first).otherwise(F.col("text"))
    old, new = turns.where("k <> 0").select("path", F.when(F.col("k") == 1, F.regexp_replace("text", r"[^\n]+", name)).otherwise(F.col("text")).alias("text")), turns.where("k <> 1").select("path", later.alias("text"))
    return line_diff.changes(old, new).select("path", "old_path", "status", "added", "removed")
