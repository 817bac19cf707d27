"""Links, degrees, components, chains, and checks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioq.operators import graph, lint, names, refactor
from folioq.plans.register import registry
from folioq.plans.tables import NOW, ORDER_LINKS, PAGES, PART_EDGES, TODAY, order_links, pages, part_edges, table
from folioq.sources import sinks
from folioq.store import checkpoints

QUERIES, ORACLES, query = registry()
_HREF = r'href="(/[^"]*)"'


def _linked_pages(spark, sf_dir):
    """Web pages as pages of the vault: the path of the url is the id, and the links of the markup stand in the body as markdown and, every other page, wiki links."""
    hrefs = F.regexp_extract_all("html", F.lit(_HREF))
    marked = F.transform(hrefs, lambda h: F.concat(F.lit("[x](topics"), h, F.lit(".md?a#top)")))
    wiki = F.transform(hrefs, lambda h: F.concat(F.lit("[[topics"), h, F.lit("#top|x]]")))
    body = F.array_join(F.when(F.col("page_id") % 2 == 0, marked).otherwise(wiki), " text ")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("topics"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)).alias("known"), body.alias("body"))


_LINKS = rf"""hrefs AS (SELECT 'pages/' || page_id AS src, page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS h FROM pages),
links AS (SELECT src, CASE WHEN page_id % 2 = 0 THEN regexp_replace(regexp_replace('topics' || h || '.md', '[?#].*$', ''), '\.md$', '') ELSE trim('topics' || h || '#top', ' ') END AS raw
  FROM hrefs WHERE CASE WHEN page_id % 2 = 0 THEN regexp_full_match('topics' || h, '[^()\s]+') AND regexp_matches('topics' || h, '^topics/.') AND regexp_matches(regexp_replace(regexp_replace('topics' || h || '.md', '[?#].*$', ''), '\.md$', ''), '^topics/.') ELSE regexp_full_match(h, '[^\[\]|]*') END),
edges AS (SELECT src, raw, trim(split_part(raw, '#', 1), ' ') AS dst FROM links)"""


def _edges(spark, sf_dir):
    return graph.raw_edges(_linked_pages(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT src, raw, dst, count(*) AS n FROM edges GROUP BY ALL")
def link_extract(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("src", "raw", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT dst, count(DISTINCT src) AS pages FROM edges WHERE dst <> '' GROUP BY dst")
def backlink_counts(spark, sf_dir):
    return _edges(spark, sf_dir).where("dst <> ''").select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("pages"))


@query(rf"""WITH {_LINKS}, known AS (SELECT DISTINCT 'topics' || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT src, string_agg(DISTINCT dst, ', ' ORDER BY dst) AS targets FROM edges WHERE dst <> '' AND dst NOT IN (SELECT path FROM known) GROUP BY src""")
def broken_links(spark, sf_dir):
    """Targets that are no page's path, by page."""
    linked = _linked_pages(spark, sf_dir)
    known = linked.select(F.col("known").alias("id"), F.lit("").alias("body")).distinct()
    return graph.broken_by_source(graph.index_edges(known.unionByName(linked.select("id", "body"))).where(F.startswith("src", F.lit("pages/"))))


@query(rf"""WITH {_LINKS}, known AS (SELECT DISTINCT 'topics' || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT 'error' AS severity, 'broken-link' AS kind, src AS id, raw AS detail FROM edges WHERE dst <> '' AND dst NOT IN (SELECT path FROM known) AND raw NOT IN (SELECT path FROM known)""")
def lint_broken_links(spark, sf_dir):
    linked = _linked_pages(spark, sf_dir)
    return lint.broken_links(linked.select(F.col("known").alias("id")), graph.raw_edges(linked))


@query(rf"""WITH {PAGES} SELECT id AS src, unnest(regexp_extract_all(body, '\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]', 1)) AS raw FROM (SELECT id, coalesce(body, '') || ' [[documents/1]]' AS body FROM pages)""")
def text_links(spark, sf_dir):
    """Wiki links of documents' texts, a link added to each."""
    rows = pages(spark, sf_dir).select("id", F.concat(F.coalesce("body", F.lit("")), F.lit(" [[documents/1]]")).alias("body"))
    return graph.raw_edges(rows).select("src", "raw")


@query(f"WITH {ORDER_LINKS} SELECT dst AS id, count(DISTINCT src) AS inbound FROM order_links WHERE src <> dst GROUP BY dst")
def inbound_degree(spark, sf_dir):
    return graph.inbound(order_links(spark, sf_dir))


@query(f"WITH {ORDER_LINKS} SELECT DISTINCT src FROM order_links WHERE dst = 'parts/5'")
def backlinks(spark, sf_dir):
    return graph.backlinks(order_links(spark, sf_dir), "parts/5")


@query(f"""WITH {ORDER_LINKS}, nodes AS (SELECT 'parts/' || p_partkey AS id FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 3))
SELECT DISTINCT src, dst FROM order_links WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""")
def graph_filtered(spark, sf_dir):
    """Links among the parts of three brands."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("type"), F.array("p_type").alias("tags"), F.lit(None).cast("string").alias("updated_at"))
    brands = [r[0] for r in part.select("type").distinct().orderBy("type").limit(3).collect()]
    return graph.filtered_graph(part, order_links(spark, sf_dir), types=brands)[1]


@query(f"""WITH {PAGES}, nodes AS (SELECT id FROM pages WHERE (lang IN ('en', 'de') OR source = 'src1') AND updated_at >= '2024-03-01')
SELECT DISTINCT id AS src, cited AS dst FROM pages WHERE id IN (SELECT id FROM nodes) AND cited IN (SELECT id FROM nodes)""")
def graph_by_tags(spark, sf_dir):
    """Citations among the pages that have any of three tags and were changed since a day."""
    return graph.filtered_graph(pages(spark, sf_dir), _cited(spark, sf_dir), tags=["en", "de", "src1"], after="2024-03-01")[1]


@query(f"""WITH {ORDER_LINKS}, ends AS (SELECT unnest([src, dst]) AS id FROM (SELECT DISTINCT src, dst FROM order_links)), d AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)
SELECT degree AS threshold FROM (SELECT degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS i, count(*) OVER () AS n FROM d) WHERE i = least(floor(0.15 * n), n - 1)""")
def hub_threshold(spark, sf_dir):
    return graph.hub_threshold(graph.degrees(order_links(spark, sf_dir).select("src", "dst").distinct()))


@query(f"""WITH RECURSIVE {PART_EDGES}, ends AS (SELECT src AS a, dst AS b FROM part_edges UNION SELECT dst, src FROM part_edges),
reach AS (SELECT a AS id, a AS other FROM ends UNION SELECT r.id, b.b FROM reach r JOIN ends b ON b.a = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def components(spark, sf_dir):
    return _checkpointed(spark, lambda: graph.components(part_edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {PART_EDGES}, ends AS (SELECT src AS a, dst AS b FROM part_edges UNION SELECT dst, src FROM part_edges),
reach AS (SELECT a AS id, a AS other FROM ends UNION SELECT r.id, b.b FROM reach r JOIN ends b ON b.a = r.other)
SELECT component, count(*) AS pages FROM (SELECT id, min(other) AS component FROM reach GROUP BY id) GROUP BY component""")
def component_sizes(spark, sf_dir):
    return graph.cluster_sizes(components(spark, sf_dir))


@query(f"""WITH {PAGES}, twice AS (SELECT id FROM pages UNION ALL SELECT id FROM pages WHERE split_part(id, '/', 2)::BIGINT % 10 = 0)
SELECT 'error' AS severity, 'duplicate-id' AS kind, id, count(*)::VARCHAR AS detail FROM twice GROUP BY id HAVING count(*) > 1""")
def lint_duplicate_ids(spark, sf_dir):
    """Pages of which every tenth stands twice."""
    rows = pages(spark, sf_dir).select("id")
    return lint.duplicate_ids(rows.unionByName(rows.where(F.substring_index("id", "/", -1).cast("long") % 10 == 0)))


_BOOK = """book AS (
  SELECT 'documents/' || doc_id AS id, '[[documents/' || (doc_id % 7) || '|see]] ' || coalesce(source, '') AS body, CASE WHEN doc_id % 11 = 0 THEN 'documents/' || (doc_id % 4) END AS superseded_by,
         ['documents/' || (doc_id % 5), 'documents/4'] AS sources, [coalesce(lang, '')] AS tags FROM documents)"""


def _book(spark, sf_dir):
    """Pages that link to seven of them."""
    d = F.col("doc_id")
    name = lambda c: F.concat(F.lit("documents/"), c.cast("string"))
    body = F.concat(F.lit("[["), name(d % 7), F.lit("|see]] "), F.coalesce("source", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(name(d).alias("id"), body.alias("body"), F.when(d % 11 == 0, name(d % 4)).alias("superseded_by"), F.array(name(d % 5), F.lit("documents/4")).alias("sources"), F.array(F.coalesce("lang", F.lit(""))).alias("tags"))
    return rows.withColumns({"aliases": F.array().cast("array<string>"), "keep": F.lit(False)})


def _told(rows):
    return rows.select("id", "body", "superseded_by", F.array_join("sources", ",").alias("sources"), F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"))


_DISTINCT = "array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: list_position(s, s[i]) = i), lambda i: s[i]), ',')"


@query(f"""WITH {_BOOK}, moved AS (SELECT *, list_transform(sources, lambda x: CASE WHEN x = 'documents/3' THEN 'topics/new' ELSE x END) AS s FROM book)
SELECT CASE WHEN id = 'documents/3' THEN 'topics/new' ELSE id END AS id, replace(body, '[[documents/3|', '[[topics/new|') AS body, CASE WHEN superseded_by = 'documents/3' THEN 'topics/new' ELSE superseded_by END AS superseded_by,
       {_DISTINCT} AS sources, array_to_string(tags, ',') AS tags, '' AS aliases FROM moved""")
def page_renamed(spark, sf_dir):
    return _told(refactor.renamed(_book(spark, sf_dir), "documents/3", "topics/new"))


@query(f"""WITH {_BOOK} SELECT id, replace(body, '[[documents/3|see]]', 'see') AS body, CASE WHEN superseded_by <> 'documents/3' THEN superseded_by END AS superseded_by,
       array_to_string(list_filter(sources, lambda x: x <> 'documents/3'), ',') AS sources, array_to_string(tags, ',') AS tags, '' AS aliases FROM book WHERE id <> 'documents/3'""")
def page_deleted(spark, sf_dir):
    return _told(refactor.deleted(_book(spark, sf_dir), "documents/3", force=True))


@query(f"""WITH {_BOOK}, given AS (SELECT body AS gb, sources AS gs, tags AS gt FROM book WHERE id = 'documents/3'),
met AS (SELECT id, CASE WHEN id = 'documents/4' THEN body || chr(10) || chr(10) || gb ELSE body END AS body, superseded_by, CASE WHEN id = 'documents/4' THEN list_filter(list_concat(sources, gs), lambda x: x <> 'documents/4') ELSE list_transform(sources, lambda x: CASE WHEN x = 'documents/3' THEN 'documents/4' ELSE x END) END AS s,
  CASE WHEN id = 'documents/4' AND tags <> gt THEN list_concat(tags, gt) ELSE tags END AS tags FROM book, given WHERE id <> 'documents/3')
SELECT id, replace(body, '[[documents/3|', '[[documents/4|') AS body, CASE WHEN superseded_by = 'documents/3' THEN 'documents/4' ELSE superseded_by END AS superseded_by,
       replace({_DISTINCT}, 'documents/3', 'documents/4') AS sources, array_to_string(tags, ',') AS tags, CASE WHEN id = 'documents/4' THEN 'documents/3' ELSE '' END AS aliases FROM met""")
def pages_merged(spark, sf_dir):
    return _told(refactor.merged(_book(spark, sf_dir), "documents/3", "documents/4"))


@query(f"WITH {_BOOK} SELECT id FROM book WHERE id <> 'documents/3' AND (contains(body, '[[documents/3|') OR coalesce(superseded_by, '') = 'documents/3' OR list_contains(sources, 'documents/3'))")
def page_references(spark, sf_dir):
    return refactor.references(_book(spark, sf_dir), "documents/3")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), step AS (SELECT c_custkey AS id, (c_custkey * 3) % n + 1 AS next FROM customer, n),
walk AS (SELECT id, next AS node, 1 AS length FROM step UNION ALL SELECT w.id, s.next, w.length + 1 FROM walk w JOIN step s ON s.id = w.node WHERE w.node <> w.id AND w.length < (SELECT n FROM n))
SELECT id, length::BIGINT AS length FROM walk WHERE node = id""")
def supersede_cycles(spark, sf_dir):
    """Customers, each followed by another; those whose chain returns to them."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    n = customer.count()
    return _checkpointed(spark, lambda: graph.returning_chains(customer.select("id", ((F.col("id") * 3) % F.lit(n) + 1).alias("next"))))


def _checkpointed(spark, run):
    """run() with a checkpoint folder: the session's, or one of its own where none is set."""
    checkpoints(spark)
    return run()


@query("""SELECT user_id AS id, x, y, updated_at FROM (SELECT user_id, value AS x, event_id::DOUBLE AS y, ts AS updated_at,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_positions(spark, sf_dir):
    moves = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"), F.col("ts").alias("updated_at"))
    return graph.last_positions(moves)


def _vault(spark, sf_dir):
    """Documents as pages of a vault on which every rule finds something."""
    d = F.col("d")
    rows = pages(spark, sf_dir).withColumn("d", F.substring_index("id", "/", -1).cast("long"))
    kind = F.get(F.array(*map(F.lit, _TYPES)), F.pmod(d, F.lit(len(_TYPES))).cast("int"))
    extra = F.when(d % 6 == 0, "\n| [[entities/b|B]] |").when(d % 8 == 1, " [a](entities/a.md) [b](topics/b.md#x) [c](https://e.org/a)").otherwise("")
    pair = F.concat(F.lit("documents/"), F.when(d % 20 == 0, d + 1).otherwise(d - 1).cast("string"))
    after = F.when(F.pmod(d, F.lit(20)) < 2, pair).when(d % 33 == 3, "documents/none").when(d % 11 == 0, F.col("superseded_by"))
    return rows.select("id", kind.alias("type"), "title", F.concat(F.coalesce("body", F.lit("")), extra).alias("body"), "summary", F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("sources")).alias("sources"), after.alias("superseded_by"), F.when(d % 50 == 7, "soon").otherwise(F.col("valid_from")).alias("valid_from"), "valid_to")


_TYPES = ["entity", "concept", "source", "topic", "odd"]
_VAULT = rf"""{PAGES},
numbered AS (SELECT *, split_part(id, '/', 2)::BIGINT AS d FROM pages),
vault AS (
  SELECT id, ({_TYPES!r})[d % 5 + 1] AS type, title, coalesce(body, '') || CASE WHEN d % 6 = 0 THEN chr(10) || '| [[entities/b|B]] |' WHEN d % 8 = 1 THEN ' [a](entities/a.md) [b](topics/b.md#x) [c](https://e.org/a)' ELSE '' END AS body, summary,
         CASE WHEN d % 3 = 0 THEN [] ELSE [cited] END AS sources, CASE WHEN d % 20 < 2 THEN 'documents/' || CASE WHEN d % 20 = 0 THEN d + 1 ELSE d - 1 END WHEN d % 33 = 3 THEN 'documents/none' ELSE superseded_by END AS superseded_by,
         CASE WHEN d % 50 = 7 THEN 'soon' ELSE valid_from END AS valid_from, valid_to FROM numbered),
found AS (
  SELECT 'error' AS severity, 'unregistered-type' AS kind, id, type AS detail FROM vault WHERE type = 'odd'
  UNION ALL SELECT 'warning', 'missing-title', id, '' FROM vault WHERE trim(coalesce(title, '')) = ''
  UNION ALL SELECT 'warning', 'missing-summary', id, '' FROM vault WHERE trim(coalesce(summary, '')) = ''
  UNION ALL SELECT 'warning', 'missing-sources', id, '' FROM vault WHERE len(sources) = 0 AND type IN ('entity', 'concept')
  UNION ALL SELECT 'warning', 'wikilink-pipe-in-table-cell', id, '' FROM vault WHERE len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '|') AND regexp_matches(x, '\[\[[^\]]*\|[^\]]*\]\]'))) > 0
  UNION ALL SELECT 'warning', 'non-canonical-wiki-link', id, n::VARCHAR FROM (SELECT id, len(list_filter(regexp_extract_all(body, '\[[^\[\]]*\]\(([^()\s]+)\)', 1), lambda x: regexp_matches(x, '^(entities|concepts|sources|topics)/.'))) AS n FROM vault) WHERE n > 0
  UNION ALL SELECT 'warning', 'invalid-date', id, 'valid_from soon' FROM vault WHERE valid_from = 'soon'
  UNION ALL SELECT 'warning', 'invalid-date', id, 'valid_from after valid_to' FROM vault WHERE valid_from > valid_to AND valid_from <> 'soon')"""


@query(f"WITH {_VAULT} SELECT * FROM found")
def lint_page_rules(spark, sf_dir):
    """Rules that look at one page."""
    return lint.page_rules(_vault(spark, sf_dir))


_REFERENCES = f"""{_VAULT},
refs AS (
  SELECT 'error' AS severity, 'dangling-supersede' AS kind, id, superseded_by AS detail FROM vault WHERE coalesce(superseded_by, '') <> '' AND superseded_by NOT IN (SELECT id FROM vault)
  UNION ALL SELECT 'error', 'supersede-cycle', id, '2' FROM vault WHERE split_part(id, '/', 2)::BIGINT % 20 < 2 AND superseded_by IN (SELECT id FROM vault)
  UNION ALL SELECT 'warning', 'broken-source', id, sources[1] FROM vault WHERE len(sources) > 0 AND sources[1] NOT IN (SELECT id FROM vault))"""


def _references(spark, sf_dir):
    return _checkpointed(spark, lambda: lint.reference_rules(_vault(spark, sf_dir).drop("body")))


@query(f"WITH {_REFERENCES} SELECT * FROM refs")
def lint_reference_rules(spark, sf_dir):
    return _references(spark, sf_dir)


@query(f"WITH {_REFERENCES} SELECT severity, kind, count(*) AS n FROM (SELECT * FROM found UNION ALL SELECT * FROM refs) GROUP BY ALL")
def lint_kind_counts(spark, sf_dir):
    return lint.shown(lint.page_rules(_vault(spark, sf_dir)).unionByName(_references(spark, sf_dir)))


@query(f"WITH {_REFERENCES} SELECT severity, kind, count(*) OVER (PARTITION BY severity, kind) AS n, id || ': ' || detail AS item FROM refs")
def audit_report(spark, sf_dir):
    return sinks.audit_groups(_references(spark, sf_dir))


@query(f"""WITH {_VAULT} SELECT * FROM found WHERE kind = 'invalid-date' AND id IN (SELECT id FROM vault WHERE type = 'source')""")
def lint_of_written_pages(spark, sf_dir):
    """One kind of finding, of some pages only."""
    vault = _vault(spark, sf_dir)
    return lint.of_paths(lint.shown(lint.page_rules(vault), True, "invalid-date"), vault.where("type = 'source'"))


_SHARED = rf"""WITH n AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '/' || p_partkey AS id, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS dir, p_type, p_partkey AS d,
  trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS key FROM part),
groups AS (SELECT p_type, key, count(*) AS n, min(id) AS first FROM n GROUP BY ALL HAVING count(*) > 1)"""


@query(f"""{_SHARED}, pairs AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.p_type = b.p_type AND a.key = b.key AND a.id < b.id JOIN groups g ON g.p_type = a.p_type AND g.key = a.key WHERE g.n <= 10 OR a.id = g.first)
SELECT 'warning' AS severity, 'duplicate-candidate' AS kind, a AS id, b || ' (same title)' AS detail FROM pairs UNION ALL SELECT 'warning', 'duplicate-candidate', b, a || ' (same title)' FROM pairs
UNION ALL SELECT 'note', 'duplicate-detection-skipped', '', n || ' pages of type ' || p_type || ' share the title ' || key FROM groups WHERE n > 10
UNION ALL SELECT 'note', 'hygiene-skipped', '', 'the index holds vectors of hash, not of model'""")
def lint_duplicates_and_notes(spark, sf_dir):
    """Duplicate titles under both pages, and the notes of a check whose index has another embedder's vectors."""
    brand = F.regexp_replace(F.lower("p_brand"), r"[^a-z0-9]", "")
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", brand, F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("title"))
    titles, notes = names.title_pairs(rows)
    none = spark.createDataFrame([], "id string, type string, embedding array<double>")
    contents, large = names.content_pairs(none)
    return lint.duplicate_candidates(names.ranked_pairs(titles, contents, none)).unionByName(lint.notes(notes, large, "hash", "model"))


def _cited(spark, sf_dir):
    """Each page links to the page it cites."""
    return pages(spark, sf_dir).select(F.col("id").alias("src"), F.explode("sources").alias("raw")).withColumn("dst", F.col("raw"))


@query(f"""WITH {PAGES}, old AS (SELECT id FROM pages WHERE valid_to < '{TODAY}'),
alive AS (SELECT id FROM pages WHERE NOT coalesce(valid_to < '{TODAY}', FALSE) AND coalesce(superseded_by, '') = ''),
met AS (SELECT p.cited AS id, list_sort(list(DISTINCT p.id)) AS s FROM pages p SEMI JOIN alive a ON a.id = p.id SEMI JOIN old o ON o.id = p.cited WHERE p.id <> p.cited GROUP BY p.cited)
SELECT 'warning' AS severity, 'expired-but-linked' AS kind, id, array_to_string(s[1:5], ', ') || CASE WHEN len(s) > 5 THEN ' and ' || (len(s) - 5) || ' more' ELSE '' END AS detail FROM met""")
def expired_but_linked(spark, sf_dir):
    return lint.expired_but_linked(pages(spark, sf_dir).drop("body"), _cited(spark, sf_dir), TODAY)


@query("""SELECT 'warning' AS severity, 'orphan' AS kind, 'customers/' || c_custkey AS id, '' AS detail FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans(spark, sf_dir):
    """Customers that no order links to."""
    name = lambda c: F.concat(F.lit("customers/"), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    edges = orders.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("src"), name("o_custkey").alias("raw"), name("o_custkey").alias("dst"))
    customers = table(spark, sf_dir, "customer").select(name("c_custkey").alias("id"), F.lit(1).cast("long").alias("file_mtime"), F.lit(False).alias("keep"))
    return lint.orphans(customers, edges, NOW)


@query(r"""WITH linked AS (SELECT doc_id, '[[documents/' || (doc_id % 7) || '|see]] and [x](documents/3.md#top) ' || coalesce(source, '') AS body FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(body, '\[\[documents/3((?:#[^\[\]|]*)?(?:\|[^\[\]]*)?)\]\]', '[[topics/new\1]]', 'g'), '(\[[^\[\]]*\])\(documents/3((?:\.md)?(?:#[^()\s]*)?)\)', '\1(topics/new\2)', 'g') AS body FROM linked""")
def link_rewrite(spark, sf_dir):
    """Links to one page follow its new name."""
    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("[[documents/"), (F.col("doc_id") % 7).cast("string"), F.lit("|see]] and [x](documents/3.md#top) "), F.coalesce("source", F.lit("")))
    return docs.select("doc_id", refactor.retargeted(body, "documents/3", "topics/new").alias("body"))
