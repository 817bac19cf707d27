"""The filter language, facets, listings, exports, names and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import filters, names, refactor, similar_join
from folioq.operators.upkeep import access_counts
from folioq.plans.register import registry
from folioq.plans.tables import ACCESS, PAGES, TODAY, VALID_NOW, access_events, pages, table
from folioq.sources import sinks, vault

QUERIES, ORACLES, query = registry()


def _hits(spark, sf_dir, text, prefix=""):
    return filters.run_query(pages(spark, sf_dir), access_counts(access_events(spark, sf_dir)), text, TODAY, prefix)


def _shown(rows, *more):
    return rows.select("id", "type", "path", F.coalesce("title", F.lit("")).alias("title"), "updated_at", "reads", "search_hits", "validity", F.array_join("tags", ",").alias("tags"), F.coalesce("summary", F.lit("")).alias("summary"), *more)


_LABEL = f"""CASE WHEN coalesce(superseded_by, '') <> '' THEN 'superseded' WHEN valid_to < '{TODAY}' THEN 'expired' WHEN valid_from > '{TODAY}' THEN 'upcoming' ELSE 'current' END"""


def _sql(where: str, tail: str = "") -> str:
    return f"""WITH {PAGES}, {ACCESS}
SELECT id, type, path, coalesce(title, '') AS title, updated_at, coalesce(reads, 0) AS reads, coalesce(search_hits, 0) AS search_hits, {_LABEL} AS validity,
       array_to_string(list_sort([lang, source]), ',') AS tags, trim(coalesce(summary, '')) AS summary
FROM pages LEFT JOIN access ON page_id = id WHERE {where} {tail}"""


@query(_sql(f"type = 'en' AND (source = 'src1' OR source = 'src2') AND NOT lower(title) LIKE '%the%' AND {VALID_NOW}"))
def filter_and_or_not(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, "type:en AND (tag:src1 OR tag:src2) AND NOT title:THE"))


@query(_sql(f"coalesce(title, '') > 'M' AND updated_at < '2024-09-01' AND id <> 'documents/5' AND {VALID_NOW}"))
def filter_ranges(spark, sf_dir):
    """Comparisons of title and dates; tags have no order, so a range of them holds for no page."""
    return _shown(_hits(spark, sf_dir, "title:>M AND created:<2024-09-01 AND NOT tag:>a AND NOT id:documents/5"))


@query(_sql(f"updated_at > '2024-06-01' AND {VALID_NOW}"))
def filter_default_validity(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, "updated:>2024-06-01"))


@query(f"""WITH {PAGES}, {ACCESS} SELECT id, coalesce(superseded_by, '') AS superseded_by, last_read_at, {_LABEL} AS validity FROM pages LEFT JOIN access ON page_id = id""")
def filter_shown_columns(spark, sf_dir):
    """What else is shown of each page: what superseded it, and when it was last read."""
    return _hits(spark, sf_dir, "valid:all").select("id", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), "last_read_at", "validity")


@query(_sql(f"(source = 'src3' OR type = 'de') AND NOT ({VALID_NOW})"))
def filter_expired(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, "(tag:src3 OR type:de) AND valid:expired"))


@query(_sql(VALID_NOW))
def filter_everything(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, "*"))


@query(_sql(f"starts_with(id, 'documents/1') AND {VALID_NOW}", "ORDER BY coalesce(updated_at, '') DESC, id LIMIT 100 OFFSET 20"))
def filter_page_offset(spark, sf_dir):
    return _shown(filters.paged(_hits(spark, sf_dir, "*", prefix="documents/1"), 20, 100))


@query(_sql(VALID_NOW, "ORDER BY coalesce(updated_at, '') DESC, id LIMIT 100 OFFSET 50").replace("AS summary\n", "AS summary, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 150 THEN 150 END AS next_offset\n"))
def filter_page_with_total(spark, sf_dir):
    """The second page of a list, with the list's length and where the next page begins."""
    page = filters.page_with_total(_hits(spark, sf_dir, "*"), 50)
    return _shown(page, "total", "next_offset")


@query(_sql("TRUE", "ORDER BY coalesce(updated_at, '') DESC, id LIMIT 200").replace("AS summary\n", "AS summary, count(*) OVER () AS total\n"))
def filter_first_with_total(spark, sf_dir):
    return _shown(filters.first_with_total(_hits(spark, sf_dir, "valid:all")), "total")


@query(_sql("TRUE", "ORDER BY coalesce(reads, 0) * 2 + coalesce(search_hits, 0) DESC, updated_at DESC, id LIMIT 100"))
def salience_order(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, "valid:all AND sort:salience").limit(100))


@query(f"WITH {PAGES} SELECT tag, count(*) AS pages FROM (SELECT unnest([lang, source]) AS tag FROM pages) GROUP BY tag")
def tag_facet(spark, sf_dir):
    """All pages, valid or not."""
    return filters.tag_facet(pages(spark, sf_dir))


@query(f"WITH {PAGES} SELECT tag, count(*) AS pages FROM (SELECT unnest([lang, source]) AS tag FROM pages WHERE type = 'en' AND {VALID_NOW}) GROUP BY tag")
def tag_facet_filtered(spark, sf_dir):
    return filters.tag_facet(_hits(spark, sf_dir, "type:en"))


@query(f"WITH {PAGES} SELECT {_LABEL} AS validity, count(*) AS n FROM pages GROUP BY 1")
def validity_labels(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(filters.validity(TODAY).alias("validity")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS directory, p_brand || '/' || p_partkey AS id FROM part")
def tree_listing(spark, sf_dir):
    return vault.tree(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("id")))


@query(f"""WITH {PAGES} SELECT type, count(*) OVER (PARTITION BY type) AS n, max(nullif(updated_at, '')) OVER (PARTITION BY type) AS last_updated, id, coalesce(title, id) AS title, updated_at FROM pages""")
def catalogue(spark, sf_dir):
    return sinks.catalogue(pages(spark, sf_dir))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN regexp_matches(text, '^[=+\\-@\t\r]') THEN '''' || text ELSE text END AS text, source FROM documents""".replace("\\\\", "\\"))
def csv_cells(spark, sf_dir):
    return sinks.csv_safe(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source"))


@query(f"WITH {PAGES} SELECT id, valid_to, row_number() OVER (ORDER BY nullif(valid_to, '') DESC NULLS LAST, id) AS place FROM pages QUALIFY place <= 300")
def table_sort(spark, sf_dir):
    """Ordered by a column with gaps; the first 300, as a list shows them."""
    top = sinks.ordered_table(pages(spark, sf_dir).select("id", "valid_to"), "valid_to", ascending=False).limit(300)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("valid_to").desc_nulls_last(), "id")).cast("long"))


@query(f"WITH {PAGES} SELECT id, valid_to, row_number() OVER (ORDER BY nullif(valid_to, '') ASC NULLS LAST, id) AS place FROM pages QUALIFY place <= 300")
def table_sort_ascending(spark, sf_dir):
    top = sinks.ordered_table(pages(spark, sf_dir).select("id", "valid_to"), "valid_to").limit(300)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("valid_to").asc_nulls_last(), "id")).cast("long"))


_SLUG = r"regexp_replace(regexp_replace(replace(replace(replace(replace(lower(%s), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT p_partkey, {_SLUG % 'p_name'} AS slug FROM part")
def slug_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug_key(F.col("p_name")).alias("slug"))


@query(f"SELECT p_partkey, {_SLUG % 'p_name'} AS key FROM part")
def alias_keys(spark, sf_dir):
    """Keys of names that carry a page type before them."""
    named = F.concat(F.get(F.array(*map(F.lit, T.PAGE_TYPES)), F.pmod("p_partkey", F.lit(4)).cast("int")), F.lit("/"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.alias_key(named).alias("key"))


_FOLD = "replace(replace(replace(%s, 'ae', 'a'), 'oe', 'o'), 'ue', 'u')"
_MATCH = f"CASE WHEN length({_FOLD % 'key'}) >= 8 OR contains(key, '-') THEN {_FOLD % 'key'} ELSE key END"


@query(f"""WITH f AS (SELECT split_part(text, chr(10), 1) AS line FROM documents), k AS (SELECT line AS name FROM f UNION ALL SELECT unnest(string_split(line, ' ')) FROM f), s AS (SELECT DISTINCT {_SLUG % 'name'} AS key FROM k WHERE name IS NOT NULL)
SELECT key, {_MATCH} AS match FROM s""")
def match_keys(spark, sf_dir):
    """Keys of first lines and of their words."""
    line = F.substring_index("text", "\n", 1)
    found = F.explode(F.concat(F.array(line), F.split(line, " ")))
    keys = table(spark, sf_dir, "documents").where("text is not null").select(found.alias("name")).select(T.slug_key(F.col("name")).alias("key")).distinct()
    return keys.select("key", T.match_key(F.col("key")).alias("match"))


_NAMES = f"""names AS (SELECT p_partkey AS id, p_brand AS dir, {_SLUG % 'p_name'} AS key FROM part),
folded AS (SELECT *, replace(replace(replace(key, 'ae', 'a'), 'oe', 'o'), 'ue', 'u') AS fold FROM names)"""


@query(f"""WITH {_NAMES}, asked AS (SELECT * FROM folded WHERE id = 1)
SELECT f.id FROM folded f, asked a WHERE f.id <> 1 AND least(length(f.key), length(a.key)) >= 3
AND (f.fold = a.fold OR levenshtein(f.key, a.key) <= CASE WHEN least(length(f.key), length(a.key)) < 8 THEN 1 ELSE 2 END)""")
def similar_names(spark, sf_dir):
    """Parts whose name is close to that of one part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.slug_key(F.col("p_name")).alias("key"))
    asked = part.where("id = 1").select("key").first()
    return part.where((F.col("id") != 1) & T.similar_keys(F.col("key"), F.lit(asked[0] if asked else ""))).select("id")


def _parts_as_pages(spark, sf_dir):
    """A part's page stands in its brand's directory under its key, with its name as alias."""
    brand = F.regexp_replace(F.lower("p_brand"), r"[^a-z0-9]", "")
    return table(spark, sf_dir, "part").select(F.concat_ws("/", brand, F.col("p_partkey").cast("string")).alias("id"), F.array("p_name").alias("aliases"), F.array().cast("array<string>").alias("distinct_from"))


@query(f"""WITH n AS (SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS dir, p_partkey, {_SLUG % 'p_name'} AS key FROM part),
m AS (SELECT *, {_MATCH} AS match, dir || '/' || p_partkey AS id FROM n WHERE key <> '')
SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b ON a.dir = b.dir AND a.match = b.match AND a.id < b.id""")
def alias_collisions(spark, sf_dir):
    """All pairs of every name, as its SQL has them."""
    return names.collisions(_parts_as_pages(spark, sf_dir), None)


_TITLES = """titled AS (SELECT p_partkey AS id, p_type AS type, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS key FROM part),
sizes AS (SELECT type, key, count(*) AS n FROM titled GROUP BY ALL)"""


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("title"))


@query(f"""WITH {_TITLES} SELECT a.id AS a, b.id AS b FROM titled a JOIN titled b ON a.type = b.type AND a.key = b.key AND a.id < b.id JOIN sizes s ON s.type = a.type AND s.key = a.key WHERE s.n <= 10 OR a.id = (SELECT min(id) FROM titled t WHERE t.type = a.type AND t.key = a.key)""")
def duplicate_titles(spark, sf_dir):
    """All pairs of a title that few pages share, and each page with the first one where many do."""
    return names.title_pairs(_titled(spark, sf_dir))[0]


@query(f"WITH {_TITLES} SELECT type, key, n AS pages FROM sizes WHERE n > 10")
def duplicate_title_notes(spark, sf_dir):
    return names.title_pairs(_titled(spark, sf_dir))[1]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), "embedding")


_IDS = ["entities/A.b-{d}", "entities/a..b{d}", "entities/{d}.", "topics/x/y{d}", "odd/y{d}", "concepts/ü{d}", "sources/a{d}.md", "entities/./{d}", "entities//{d}", "C:/x{d}", "entities/_{d}", "topics/a b{d}", "concepts\\\\{d}"]
_ODD_ID = r"contains(id, '..') OR regexp_matches(id, '(^|/)\.(/|$)')"


@query(rf"""WITH i AS (SELECT doc_id, replace(([{', '.join(chr(39) + x + chr(39) for x in _IDS)}])[doc_id % {len(_IDS)} + 1], '{{d}}', doc_id::VARCHAR) AS id FROM documents)
SELECT doc_id, id, regexp_matches(id, '{refactor.ID_FORM}') AND NOT ({_ODD_ID}) AS valid, regexp_matches(id, '{refactor.NEW_ID_FORM}') AND NOT ({_ODD_ID}) AND NOT ends_with(id, '.md') AS valid_new FROM i""")
def id_forms(spark, sf_dir):
    """Ids of many forms, checked as ids of pages that exist and of new ones."""
    forms = F.array(*map(F.lit, _IDS))
    ids = F.replace(F.get(forms, F.pmod("doc_id", F.lit(len(_IDS))).cast("int")), F.lit("{d}"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("id"))
    return rows.select("doc_id", "id", refactor.valid_id(F.col("id")).alias("valid"), refactor.valid_new_id(F.col("id")).alias("valid_new"))


@query(rf"""WITH n AS (SELECT (['entities', 'concepts', 'sources', 'topics'])[p_partkey % 4 + 1] AS dir, p_partkey, p_name, {_SLUG % 'p_name'} || '-' || p_partkey AS key FROM part),
asked AS (SELECT key AS name FROM n WHERE p_partkey = 12),
pages AS (SELECT dir || '/' || key AS id, dir, key, p_name AS title, {_MATCH} AS match FROM n)
SELECT id, title, CASE WHEN key = name THEN 'exact' WHEN match = replace(replace(replace(name, 'ae', 'a'), 'oe', 'o'), 'ue', 'u') THEN 'normalised' ELSE 'similar' END AS reason
FROM pages, asked WHERE key = name OR match = replace(replace(replace(name, 'ae', 'a'), 'oe', 'o'), 'ue', 'u') OR (least(length(key), length(name)) >= 3 AND levenshtein(key, name) <= CASE WHEN least(length(key), length(name)) < 8 THEN 1 ELSE 2 END)""")
def name_lookup(spark, sf_dir):
    """A bare name looked up in four directories."""
    directory = F.get(F.array(*map(F.lit, T.PAGE_TYPES)), F.pmod("p_partkey", F.lit(4)).cast("int"))
    key = F.concat_ws("-", T.slug_key(F.col("p_name")), F.col("p_partkey").cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), F.concat_ws("/", directory, key).alias("id"), F.col("p_name").alias("title"), F.array().cast("array<string>").alias("aliases"))
    asked = part.where("p_partkey = 12").select("key").first()
    return names.lookup(part, asked[0] if asked else "-")


_CONTENT = """v AS (SELECT vec_id AS id, label AS type, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT type, count(*) AS n FROM v GROUP BY type),
content AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.type = b.type AND a.id < b.id JOIN ok ON ok.type = a.type WHERE n <= CAP OR a.id % 50 = 0 OR b.id % 50 = 0)"""


def _contents(spark, sf_dir, cap=names.CONTENT_CAP):
    return names.content_pairs(_vectors(spark, sf_dir), 0.3, cap, F.pmod("id", F.lit(50)) == 0)


@query(f"WITH {_CONTENT} SELECT * FROM content WHERE similarity >= 0.3".replace("CAP", "30"))
def duplicate_contents_of_large_types(spark, sf_dir):
    """Types above a cap of 30: every fiftieth embedding against all of its type."""
    return _contents(spark, sf_dir, 30)[0]


@query("SELECT label AS type, count(*) AS pages FROM embeddings GROUP BY label HAVING count(*) > 30")
def duplicate_content_notes(spark, sf_dir):
    return _contents(spark, sf_dir, 30)[1]


@query(f"WITH {_CONTENT} SELECT * FROM content WHERE similarity >= 0.3".replace("CAP", str(names.CONTENT_CAP)))
def duplicate_contents(spark, sf_dir):
    """Embeddings of one label that are nearly equal."""
    return _contents(spark, sf_dir)[0]


@query(f"WITH {_CONTENT} SELECT * FROM content WHERE similarity >= 0.4".replace("CAP", "1000000000"))
def similar_contents(spark, sf_dir):
    """All pairs of embeddings of one label that are similar, whatever the number of its rows."""
    return similar_join.similar_pairs(_vectors(spark, sf_dir), 0.4)


@query(f"""WITH {_CONTENT}, near AS (SELECT * FROM content WHERE similarity >= 0.3),
titles AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e), 6) AS s FROM v a JOIN v b ON a.type = b.type AND b.id = a.id + 10),
pairs AS (SELECT coalesce(n.a, t.a) AS a, coalesce(n.b, t.b) AS b, coalesce(similarity, s) AS similarity, t.a IS NOT NULL AS by_title FROM titles t FULL JOIN near n ON n.a = t.a AND n.b = t.b)
SELECT a, b, similarity, by_title, CASE WHEN by_title AND (similarity IS NULL OR similarity < 0.7) THEN 'check-or-distinct' ELSE 'merge' END AS suggestion FROM pairs""".replace("CAP", str(names.CONTENT_CAP)))
def duplicate_pairs(spark, sf_dir):
    """Pairs by content and by name (here: the embedding ten ids on), merged and with a suggestion."""
    v = _vectors(spark, sf_dir)
    ahead = v.select((F.col("id") - 10).alias("a"), F.col("id").alias("b"), F.col("type"))
    titles = ahead.join(v.select(F.col("id").alias("a"), "type"), ["a", "type"]).select("a", "b")
    return names.ranked_pairs(titles, _contents(spark, sf_dir)[0], v)


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(0, ceil((len(ws) - 220) / 160))::BIGINT + 1 END)) AS chunk_idx FROM w)
SELECT doc_id, chunk_idx::INTEGER AS chunk_idx, md5(array_to_string(ws[chunk_idx * 160 + 1:chunk_idx * 160 + 220], ' ')) AS chunk_md5 FROM n""")
def chunk_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.word_windows(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.chunk_idx", F.md5("c.chunk").alias("chunk_md5"))


_WHITE = r"trim(regexp_replace(coalesce(%s, ''), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ')"


@query(f"""WITH named AS (SELECT doc_id, {_WHITE % "CASE WHEN doc_id % 4 <> 1 THEN split_part(text, chr(10), 1) END"} AS t, {_WHITE % "CASE WHEN doc_id % 5 <> 2 THEN lang END"} AS k, {_WHITE % 'source'} AS h, {_WHITE % "CASE WHEN doc_id % 3 <> 0 THEN text END"} AS s FROM documents),
lines AS (SELECT doc_id, s, array_to_string(list_filter([CASE WHEN t <> '' AND k <> '' THEN t || ' (' || k || ')' WHEN k <> '' THEN '(' || k || ')' ELSE t END, h], lambda x: x <> ''), ' › ') AS l FROM named),
cut AS (SELECT doc_id, s, CASE WHEN length(l) <= 160 THEN l ELSE substring(l, 1, 159) || '…' END AS l FROM lines),
full_ AS (SELECT doc_id, CASE WHEN s = '' THEN l WHEN l = '' THEN s ELSE l || ' — ' || s END AS l, s FROM cut)
SELECT doc_id, CASE WHEN s = '' OR length(l) <= 280 THEN l ELSE substring(l, 1, 279) || '…' END AS header FROM full_""")
def contextual_headers(spark, sf_dir):
    """Headers with and without title, type and summary."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    title, kind, summary = F.when(d % 4 != 1, F.substring_index("text", "\n", 1)), F.when(d % 5 != 2, F.col("lang")), F.when(d % 3 != 0, F.col("text"))
    return docs.select("doc_id", T.contextual_header(title, kind, F.array("source"), summary).alias("header"))


@query(f"""WITH f AS (SELECT doc_id, {_WHITE % "replace(replace(text, '«', ''), '»', '')"} AS t FROM documents),
h AS (SELECT *, substring(t, 1, 79) AS head FROM f)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(coalesce(nullif(regexp_extract(head, '^(.+) [^ ]*$', 1), ''), head), ' ,;:.-…') || '…' END AS snippet FROM h""")
def plain_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_snippet(F.col("text")).alias("snippet"))


def _edited_names(spark, sf_dir):
    """Names of parts in four directories, and wanted ids: each name with a letter gone, changed, added or doubled, or as it is, in another spelling."""
    directory = F.get(F.array(*map(F.lit, T.PAGE_TYPES)), F.pmod("p_partkey", F.lit(4)).cast("int"))
    key, d = T.slug_key(F.concat_ws("-", F.substring("p_name", 1, 12), F.col("p_partkey").cast("string"))), F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select(d, F.concat_ws("/", directory, key).alias("id"), F.array("p_name", F.concat(F.lit("Ü"), d.cast("string"))).alias("aliases"), key.alias("key"), directory.alias("directory"))
    at = F.pmod(d, F.lit(7)) + 2
    cut = lambda a, b: F.concat(F.substring(F.col("key"), F.lit(1), a), b)
    rest = lambda a: F.substring(F.col("key"), a, F.length("key"))
    new = F.when(d % 5 == 0, cut(at, rest(at + 2))).when(d % 5 == 1, cut(at, F.concat(F.lit("x"), rest(at + 2)))).when(d % 5 == 2, cut(at, F.concat(F.lit("qq"), rest(at + 1)))).when(d % 5 == 3, F.concat(F.lit("ue"), d.cast("string"))).otherwise(F.col("key"))
    return pages.select("id", "aliases"), pages.select(F.concat_ws("/", "directory", new).alias("id")).distinct()


@query(rf"""WITH n AS (SELECT (['entities', 'concepts', 'sources', 'topics'])[p_partkey % 4 + 1] AS dir, p_partkey AS d, p_name, {_SLUG % "(substring(p_name, 1, 12) || '-' || p_partkey)"} AS k FROM part),
asked AS (SELECT DISTINCT dir, CASE d % 5 WHEN 0 THEN substring(k, 1, d % 7 + 2) || substring(k, d % 7 + 4) WHEN 1 THEN substring(k, 1, d % 7 + 2) || 'x' || substring(k, d % 7 + 4) WHEN 2 THEN substring(k, 1, d % 7 + 2) || 'qq' || substring(k, d % 7 + 3) WHEN 3 THEN 'ue' || d ELSE k END AS wanted FROM n),
entries AS (SELECT dir, dir || '/' || k AS id, k AS key, FALSE AS is_alias FROM n UNION ALL SELECT dir, dir || '/' || k, {_SLUG % 'p_name'}, TRUE FROM n UNION ALL SELECT dir, dir || '/' || k, 'ue' || d, TRUE FROM n),
e AS (SELECT *, {_MATCH} AS match, {_FOLD % 'key'} AS fold FROM entries WHERE key <> ''),
a AS (SELECT dir, dir || '/' || key AS wanted, key, {_MATCH} AS match, {_FOLD % 'key'} AS fold FROM (SELECT dir, wanted AS key FROM asked)),
met AS (SELECT a.wanted, e.id, CASE WHEN e.match = a.match AND e.is_alias THEN 0 WHEN e.match = a.match THEN 1
  WHEN least(length(a.key), length(e.key)) >= 3 AND (a.fold = e.fold OR levenshtein(a.key, e.key) <= CASE WHEN least(length(a.key), length(e.key)) < 8 THEN 1 ELSE 2 END) THEN 2 END AS r
  FROM a JOIN e ON a.dir = e.dir AND a.wanted <> e.id)
SELECT wanted, id, (['alias', 'normalised', 'similar'])[min(r) + 1] AS reason FROM met WHERE r IS NOT NULL GROUP BY ALL""")
def near_names(spark, sf_dir):
    """A batch of wanted names against all pages and their aliases."""
    return names.near_matches(*_edited_names(spark, sf_dir))
