"""Full-text, vector and fused retrieval, and its quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioq.functions.text import tokens
from folioq.functions.vectors import dot, hashed_embeddings, mean_vectors
from folioq.operators import fulltext, fusion, metrics, search, segments, similar, vector_index
from folioq.plans.register import registry
from folioq.plans.tables import TOKENS, pages, table
from folioq.store import scratch

QUERIES, ORACLES, query = registry()
TERMS = ["the", "tion", "with"]
CHUNKS, CANDIDATES, LIMIT = 200, 50, 10


def _bm25_sql(fields: dict[str, float], terms: list[str]) -> str:
    """fields: SQL of a text by weight; a term with a hyphen is a phrase."""
    words = ", ".join(f"{TOKENS % f} AS words_{i}" for i, f in enumerate(fields))
    n = len(fields)

    def count(i: int, term: str) -> str:
        same = " AND ".join(f"words_{i}[p + {j}] = '{w}'" for j, w in enumerate(term.split("-")))
        return f"len(list_filter(range(1, len(words_{i}) + 1), lambda p: {same}))" if "-" in term else f"len(list_filter(words_{i}, lambda w: w = '{term}'))"

    tf = lambda t: " + ".join(f"{w:.1f}::DOUBLE * {count(i, t)}" for i, w in enumerate(fields.values()))
    parts = ", ".join(f"({tf(t)}) AS tf_{k}" for k, t in enumerate(terms))
    idf = lambda k: f"greatest(1e-6, ln((n_docs - df_{k} + 0.5) / (df_{k} + 0.5)))"
    score = " + ".join(f"{idf(k)} * tf_{k} * 2.2 / (tf_{k} + 1.2 * (0.25 + 0.75 * length / mean_length))" for k in range(len(terms)))
    return f"""words AS (SELECT doc_id, {words} FROM (SELECT *, CASE WHEN doc_id % 13 <> 0 THEN split_part(text, chr(10), 1) END AS title, CASE WHEN doc_id % 5 <> 0 THEN string_split(text, chr(10))[-1] END AS summary FROM documents)),
counted AS (SELECT doc_id, ({" + ".join(f"len(words_{i})" for i in range(n))})::DOUBLE AS length, {parts} FROM words),
totals AS (SELECT count(*) AS n_docs, avg(length) AS mean_length, {", ".join(f"count(*) FILTER (tf_{k} > 0) AS df_{k}" for k in range(len(terms)))} FROM counted),
bm25 AS (SELECT doc_id, round(({score})::DOUBLE, 6) AS score FROM counted, totals WHERE {" + ".join(f"tf_{k}" for k in range(len(terms)))} > 0)"""


_INDEXES: dict[tuple, fulltext.Index] = {}


def _numbered_pages(spark, sf_dir):
    """documents as pages, under their numbers."""
    return pages(spark, sf_dir).withColumn("id", F.substring_index("id", "/", -1).cast("long"))


def _index(spark, sf_dir) -> fulltext.Index:
    """The pages' index: built by the first query of a session that needs it, and read by all while the table has the same files."""
    docs = table(spark, sf_dir, "documents")
    sign = docs.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n"), F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct().agg(F.count("*"), F.sum(F.xxhash64("f", "n", "t").cast("decimal(38,0)"))).first()
    key = spark.sparkContext.applicationId, sf_dir, *sign
    if key not in _INDEXES:
        _INDEXES[key] = fulltext.build_index(_numbered_pages(spark, sf_dir), list(search.WEIGHTS))
    return _INDEXES[key]


def _bm25(spark, sf_dir, weights=None, terms=TERMS):
    return fulltext.bm25(_index(spark, sf_dir), weights or {"body": 1.0}, terms)


@query(f"WITH {_bm25_sql({'text': 1.0}, TERMS)} SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_documents(spark, sf_dir):
    """Best documents for three terms."""
    return _bm25(spark, sf_dir).orderBy(F.desc("score"), "id").limit(CANDIDATES).withColumnRenamed("id", "doc_id")


def _segmented(spark, sf_dir):
    """Pages indexed in five batches, of which two become one segment: first all, every fourth with another text, and pages that are none; then the real texts by two, a repeated batch, and the deletions."""
    rows = _numbered_pages(spark, sf_dir).withColumn("file_hash", F.sha2(F.coalesce("body", F.lit("")), 256))
    other = F.concat(F.lit("the tion with "), F.col("body"))
    old = rows.where("id % 4 = 0").withColumn("body", other).withColumn("file_hash", F.lit("old"))
    more = rows.where("id % 3 = 0").withColumn("id", -F.col("id") - 1)
    folder = scratch(spark, "segments")
    segments.apply(folder, rows.where("id % 4 <> 0").unionByName(old).unionByName(more), None, 0, fan=3)
    segments.apply(folder, rows.where("id % 8 <> 0"), None, 1, fan=3)
    segments.apply(folder, rows.where("id % 8 = 0"), None, 2, fan=3)
    segments.apply(folder, old, None, 2, fan=3)
    segments.prune(folder, rows, 0, fan=3)
    return segments.opened(spark, folder)


@query(f"WITH {_bm25_sql({'text': 1.0}, TERMS)} SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_of_segments(spark, sf_dir):
    """The same ranking from an index that was kept up by batches of changed and deleted pages."""
    found = fulltext.bm25(_segmented(spark, sf_dir).index, {"body": 1.0}, TERMS)
    return found.orderBy(F.desc("score"), "id").limit(CANDIDATES).withColumnRenamed("id", "doc_id")


FIELDED = ["of-the", "the", "tion"]


@query(f"WITH {_bm25_sql({'title': 3.0, 'text': 1.0, 'summary': 5.0}, FIELDED)} SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_fielded(spark, sf_dir):
    """Three fields, the title three and the summary five times as heavy as the body; one of the terms is a phrase."""
    return _bm25(spark, sf_dir, search.WEIGHTS, FIELDED).orderBy(F.desc("score"), "id").limit(CANDIDATES).withColumnRenamed("id", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS % 'text'}, ' ') || ' ', ' of the ')")
def phrase_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(fulltext.has_phrase(F.col("text"), "of-the")).select("doc_id")


@query("""SELECT doc_id, (2 * ((length(source) - length(replace(lower(source), 'c1', ''))) // 2) + (length(text) - length(replace(lower(text), 'c1', ''))) // 2)::BIGINT AS score
FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(text), 'c1')""")
def substring_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return fulltext.substring_scores(docs, "C1", "source", "text", "doc_id").withColumnRenamed("id", "doc_id")


@query("""SELECT doc_id, (2 * ((length(source) - length(replace(lower(source), 'ation the', ''))) // 9) + (length(text) - length(replace(lower(text), 'ation the', ''))) // 9)::BIGINT AS score
FROM documents WHERE contains(lower(source), 'ation the') OR contains(lower(text), 'ation the')""")
def substring_search_by_grams(spark, sf_dir):
    """The same search through an index of runs of three characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    index = fulltext.build_grams(docs, ["source", "text"], "doc_id")
    return fulltext.substring_search(docs, index, "Ation the", "source", "text", "doc_id").withColumnRenamed("id", "doc_id")


@query("""SELECT doc_id, translate(substring(text, greatest(1, strpos(lower(text), 'tion') - 40), strpos(lower(text), 'tion') - greatest(1, strpos(lower(text), 'tion') - 40) + 64), chr(10), ' ') AS snippet
FROM documents WHERE contains(lower(text), 'tion')""")
def substring_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fulltext.around(F.col("text"), "tion").alias("snippet")).where("snippet is not null")


@query()
def marked_snippets(spark, sf_dir):
    """Token windows with the most query terms; rows only."""
    docs = table(spark, sf_dir, "documents").withColumn("words", tokens(F.col("text")))
    return docs.select("doc_id", fulltext.best_window(F.col("words"), TERMS).alias("snippet"))


def _asked(spark, sf_dir, vec_id: int):
    """The embedding of one row, as a literal."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]]) if row else F.array().cast("array<double>")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 200)
SELECT label AS page, max(similarity) AS similarity, min_by(vec_id, (-similarity, vec_id)) AS best_chunk FROM near GROUP BY label""")
def knn_chunks_to_pages(spark, sf_dir):
    """The nearest chunks, then the best of each page."""
    chunks = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(dot(F.col("embedding"), _asked(spark, sf_dir, 0)), 6).alias("similarity"))
    near = chunks.orderBy(F.desc("similarity"), "vec_id").limit(CHUNKS)
    return near.groupBy(F.col("label").alias("page")).agg(F.max("similarity").alias("similarity"), F.min_by("vec_id", F.struct(-F.col("similarity"), "vec_id")).alias("best_chunk"))


@query("""WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings),
sums AS (SELECT label, place, sum(x) AS x FROM parts GROUP BY ALL), lengths AS (SELECT label, sqrt(sum(x * x)) AS n FROM sums GROUP BY label)
SELECT s.label AS page, s.place::INTEGER AS place, round(x / n, 5) AS value FROM sums s JOIN lengths USING (label)""")
def page_vectors(spark, sf_dir):
    """Mean vector of the chunks of each page."""
    means = mean_vectors(table(spark, sf_dir, "embeddings"), "label", order="vec_id")
    return means.select(F.col("label").alias("page"), F.posexplode("embedding").alias("place", "value")).withColumn("value", F.round("value", 5))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q WHERE vec_id <> 7 ORDER BY similarity DESC, vec_id LIMIT 8""")
def similar_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id <> 7")
    scored = rows.select("vec_id", "label", F.round(dot(F.col("embedding"), _asked(spark, sf_dir, 7)), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(8)


@query()
def hashed_vectors(spark, sf_dir):
    """Feature-hash embeddings of all documents, sparse; rows only, the hash is not SQL's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("words"))
    return hashed_embeddings(docs, "doc_id", "words")


_FUSED = f"""WITH {_bm25_sql({'text': 1.0}, TERMS)},
fts AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 50)),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (
  SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 50))"""


def _lists(spark, sf_dir):
    fts = _bm25(spark, sf_dir).orderBy(F.desc("score"), "id").limit(CANDIDATES)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(dot(F.col("embedding"), _asked(spark, sf_dir, 3)), 6).alias("score"))
    return fts, rows.orderBy(F.desc("score"), "id").limit(CANDIDATES)


def _rounded(df):
    return df.select("id", F.round("score", 6).alias("score"))


def _rrf_sql(weight: float, fts: str = "fts") -> str:
    return f"SELECT id, round(coalesce({weight}::DOUBLE / (60 + f.r), 0) + coalesce(1.0::DOUBLE / (60 + d.r), 0), 6) AS score FROM {fts} f FULL JOIN dense d USING (id)"


@query(f"{_FUSED} {_rrf_sql(1.0)}")
def fusion_rrf(spark, sf_dir):
    return _rounded(fusion.rrf(*_lists(spark, sf_dir)))


@query(f"{_FUSED} {_rrf_sql(0.4)}")
def fusion_weighted_rrf(spark, sf_dir):
    return _rounded(fusion.weighted_rrf(*_lists(spark, sf_dir)))


@query(f"""{_FUSED}, strong AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM fts WHERE score >= 0.5 * (SELECT max(score) FROM fts)) {_rrf_sql(1.0, 'strong')}""")
def fusion_weak_fts_ignored(spark, sf_dir):
    return _rounded(fusion.weak_fts_ignored(*_lists(spark, sf_dir)))


@query(f"""{_FUSED},
f AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM fts),
d AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM dense)
SELECT id, round(0.7::DOUBLE * coalesce(d.s, 0) + 0.3::DOUBLE * coalesce(f.s, 0), 6) AS score FROM f FULL JOIN d USING (id)""")
def fusion_convex(spark, sf_dir):
    return _rounded(fusion.convex(*_lists(spark, sf_dir)))


_DENSE_FIRST = f"""{_FUSED},
met AS (SELECT id, f.r AS fr, d.r AS dr, CASE WHEN d.r < 10 THEN 0 WHEN d.r IS NOT NULL THEN 1 ELSE 2 END AS zone,
         coalesce(1.0::DOUBLE / (10 + d.r), 0) + coalesce(0.5::DOUBLE / (60 + f.r), 0) AS raw FROM fts f FULL JOIN dense d USING (id)),
fused AS (SELECT id, row_number() OVER w AS place, min(raw) OVER (w ROWS UNBOUNDED PRECEDING) AS score FROM met WINDOW w AS (ORDER BY zone, raw DESC, coalesce(dr, fr)))"""


@query(f"{_DENSE_FIRST} SELECT id, place::INTEGER AS place, round(score, 6) AS score FROM fused")
def fusion_dense_first(spark, sf_dir):
    return fusion.dense_first(*_lists(spark, sf_dir), LIMIT).select("id", "place", F.round("score", 6).alias("score"))


@query(f"""{_DENSE_FIRST} SELECT fused.id AS doc_id, place::INTEGER AS place, round(score, 6) AS score, d.source, coalesce(d.lang, '') AS lang
FROM fused LEFT JOIN documents d ON d.doc_id = fused.id WHERE place <= 10""")
def hybrid_search(spark, sf_dir):
    """The first hits of the default fusion with what is shown of them."""
    best = fusion.dense_first(*_lists(spark, sf_dir), LIMIT).where(F.col("place") <= LIMIT)
    shown = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return shown.join(F.broadcast(best), "id", "right").select(F.col("id").alias("doc_id"), "place", F.round("score", 6).alias("score"), "source", F.coalesce("lang", F.lit("")).alias("lang"))


QUESTION = "of-the with"
_SEARCH = f"""WITH {_bm25_sql({'title': 3.0, 'text': 1.0, 'summary': 5.0}, QUESTION.split())},
fts AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 50)),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
near AS (SELECT vec_id, vec_id // 2 AS page_id, round(-list_distance(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 200),
dense AS (SELECT page_id AS id, max(score) AS score, row_number() OVER (ORDER BY max(score) DESC, page_id) - 1 AS r FROM near GROUP BY page_id),
met AS (SELECT id, f.r AS fr, d.r AS dr, CASE WHEN d.r < 10 THEN 0 WHEN d.r IS NOT NULL THEN 1 ELSE 2 END AS zone,
        coalesce(1.0::DOUBLE / (10 + d.r), 0) + coalesce(0.5::DOUBLE / (60 + f.r), 0) AS raw FROM fts f FULL JOIN dense d USING (id)),
hybrid AS (SELECT id, row_number() OVER w AS place, min(raw) OVER (w ROWS UNBOUNDED PRECEDING) AS score FROM met WINDOW w AS (ORDER BY zone, raw DESC, coalesce(dr, fr)) QUALIFY place <= 10)"""


def _chunks(spark, sf_dir):
    """embeddings as chunks, two of a page."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("page_id"), "embedding")


def _candidates(spark, sf_dir):
    return search.text_candidates(_index(spark, sf_dir), QUESTION), search.dense_candidates(_chunks(spark, sf_dir), _asked(spark, sf_dir, 3))


@query(f"""{_SEARCH} SELECT place::INTEGER AS place, hybrid.id, coalesce(CASE WHEN doc_id % 13 <> 0 THEN split_part(text, chr(10), 1) END, hybrid.id::VARCHAR) AS title, coalesce(source || '/' || doc_id, '') AS path, round(score, 6) AS score
FROM hybrid LEFT JOIN documents ON doc_id = hybrid.id""")
def search_hits(spark, sf_dir):
    """A search as users see it: fused hits with title and path (snippets: search_snippets)."""
    found = search.search(_numbered_pages(spark, sf_dir), _index(spark, sf_dir), _chunks(spark, sf_dir), QUESTION, _asked(spark, sf_dir, 3))
    return found.select("place", "id", F.col("title").cast("string").alias("title"), "path", F.round("score", 6).alias("score"))


@query()
def search_snippets(spark, sf_dir):
    """Snippets of a search's hits; rows only."""
    found = search.search(_numbered_pages(spark, sf_dir), _index(spark, sf_dir), _chunks(spark, sf_dir), QUESTION, _asked(spark, sf_dir, 3), 20)
    return found.select("place", "id", "snippet")


@query("""WITH named AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 13 <> 0 THEN split_part(text, chr(10), 1) END AS title, source || '/' || doc_id AS path FROM documents),
found AS (SELECT *, (2 * ((length(coalesce(title, '')) - length(replace(lower(coalesce(title, '')), 'a, b', ''))) // 4) + (length(text) - length(replace(lower(text), 'a, b', ''))) // 4)::DOUBLE AS score FROM named)
SELECT (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS place, id, coalesce(title, id::VARCHAR) AS title, path, score FROM found WHERE score > 0 QUALIFY place <= 10""")
def search_without_index_hits(spark, sf_dir):
    """What a search gives where the index finds nothing: pages that hold the query as it stands."""
    found = search.brute_force(_numbered_pages(spark, sf_dir), "A, b")
    return found.select("place", "id", F.col("title").cast("string").alias("title"), "path", "score")


@query(f"""{_SEARCH} SELECT 'fts-only' AS mode, id, score, (r + 1)::INTEGER AS place FROM fts WHERE r < 10
UNION ALL SELECT 'dense-only', id, score + 0.0::DOUBLE, (r + 1)::INTEGER FROM dense WHERE r < 10 UNION ALL SELECT 'hybrid', id, round(score, 6), place::INTEGER FROM hybrid""")
def search_modes(spark, sf_dir):
    """The three modes of a search over the same candidates."""
    return search.modes(*_candidates(spark, sf_dir)).withColumn("score", F.round("score", 6) + 0.0)


@query(f"""{_SEARCH} SELECT vec_id // 2 AS id, max(round(list_cosine_similarity(embedding::DOUBLE[], v), 6)) AS score FROM embeddings, q WHERE vec_id // 2 IN (SELECT id FROM fts) GROUP BY 1""")
def dense_over_candidates(spark, sf_dir):
    """Cosine of the best chunk of each full-text candidate."""
    return search.dense_over(_chunks(spark, sf_dir), _asked(spark, sf_dir, 3), search.text_candidates(_index(spark, sf_dir), QUESTION))


@query("""WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings),
sums AS (SELECT label, place, sum(x) AS x FROM parts GROUP BY ALL), means AS (SELECT label, list(x ORDER BY place) AS v FROM sums GROUP BY label),
scored AS (SELECT m.label AS id, round(list_cosine_similarity(m.v, t.v), 6) AS score FROM means m, means t WHERE t.label = 0 AND m.label NOT IN (0, 1))
SELECT id, 'label ' || id AS title, 'label' AS type, score FROM scored ORDER BY score DESC, id LIMIT 8""")
def similar_by_page_vectors(spark, sf_dir):
    """Pages (labels) like one that has no page vector of its own and says that it is distinct from another."""
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page_id"), "embedding")
    vectors = mean_vectors(chunks, "page_id", order="chunk_id")
    named = chunks.select(F.col("page_id").alias("id")).distinct().select("id", F.concat(F.lit("label "), F.col("id").cast("string")).alias("title"), F.lit("label").alias("type"), F.when(F.col("id") == 0, F.array(F.lit(1))).alias("distinct_from"))
    return similar.similar(vectors.where("page_id <> 0"), chunks, named, 0)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3),
near AS (SELECT vec_id, vec_id // 2 AS page_id, round(-list_distance(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 200)
SELECT page_id AS id, max(score) + 0.0::DOUBLE AS score FROM near GROUP BY page_id""")
def dense_candidates_by_lists(spark, sf_dir):
    """Pages of the nearest chunks, found in the lists of a vector index."""
    rows = _chunks(spark, sf_dir)
    asked = rows.where("chunk_id = 3").select(F.col("embedding").cast("array<double>")).first()
    near, _ = vector_index.nearest(vector_index.build(rows, "chunk_id"), asked[0] if asked else [0.0], CHUNKS, "chunk_id")
    return near.groupBy(F.col("page_id").alias("id")).agg((F.max("score") + 0.0).alias("score"))


def _comparison_sql() -> str:
    low_high = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"
    rrf = lambda w, f="fts": f"SELECT id, coalesce({w}::DOUBLE / (60 + f.r), 0) + coalesce(1.0::DOUBLE / (60 + d.r), 0) AS score FROM {f} f FULL JOIN dense d USING (id)"
    scored = {
        "rrf": rrf(1.0),
        "weighted-rrf": rrf(0.4),
        "weak-fts-ignored": rrf(1.0, "(SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM fts WHERE score >= 0.5 * (SELECT max(score) FROM fts))"),
        "convex": f"SELECT id, 0.7::DOUBLE * coalesce(d.s, 0) + 0.3::DOUBLE * coalesce(f.s, 0) AS score FROM (SELECT id, {low_high} AS s FROM fts) f FULL JOIN (SELECT id, {low_high} AS s FROM dense) d USING (id)",
    }
    ranked = " UNION ALL ".join(f"SELECT '{name}' AS fusion, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({sql})" for name, sql in scored.items())
    return f"""{_SEARCH}, ranked AS ({ranked} UNION ALL SELECT 'dense-first', id, place FROM hybrid),
expected AS (SELECT doc_id AS id FROM labels WHERE quality = 1),
names AS (SELECT DISTINCT fusion FROM ranked),
judged AS (SELECT n.fusion, e.id, r.rank FROM names n CROSS JOIN expected e LEFT JOIN ranked r ON r.fusion = n.fusion AND r.id = e.id AND r.rank <= 10)
SELECT fusion, round(count(rank) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS mrr,
       round(sum(coalesce(1 / log2(rank + 1), 0)) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM judged GROUP BY fusion"""


@query(_comparison_sql())
def fusion_comparison(spark, sf_dir):
    """Metrics of the five fusions on the same candidates (of one question; good documents are expected)."""
    expected = table(spark, sf_dir, "labels").where("quality = 1").select(F.lit("q").alias("query"), F.col("doc_id").alias("id"))
    out = search.fusion_comparison([("q", *_candidates(spark, sf_dir))], expected)
    return out.select("fusion", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


_RANKED = """ranked AS (
  SELECT d.lang AS query, d.doc_id AS id, row_number() OVER (PARTITION BY d.lang ORDER BY length(d.text) DESC, d.doc_id) AS rank FROM documents d),
expected AS (SELECT DISTINCT d.lang AS query, l.doc_id AS id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 AND l.toxic = 1)"""


def _rankings(spark, sf_dir):
    """For each language as a query: documents by length as its ranking, good and toxic ones as expected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    # Only the first ten of a ranking count: they come from a top list of each language, not from ranking all rows.
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("doc_id")).alias("d"))), asc=False), 1, metrics.CUT)
    parts = docs.withColumn("part", F.pmod("doc_id", F.lit(64))).groupBy("lang", "part").agg(best.alias("top")).select("lang", F.explode("top").alias("t"))
    top = parts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("t"), asc=False), 1, metrics.CUT).alias("top"))
    ranked = top.select(F.col("lang").alias("query"), F.posexplode("top").alias("p", "t")).select("query", (-F.col("t.d")).alias("id"), (F.col("p") + 1).alias("rank"))
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 1").select("doc_id")
    return ranked, docs.join(labels, "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"))


_METRICS = f"""WITH {_RANKED},
met AS (SELECT e.query, e.id, r.rank FROM expected e LEFT JOIN ranked r ON r.query = e.query AND r.id = e.id AND r.rank <= 10),
sums AS (SELECT query, count(*) AS n, count(rank) AS found, min(rank) AS first, sum(coalesce(1 / log2(rank + 1), 0)) AS dcg FROM met GROUP BY query),
per_query AS (SELECT query, found / n AS recall, coalesce(1 / first, 0) AS mrr, dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM sums)"""


@query(f"{_METRICS} SELECT query, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM per_query")
def eval_metrics(spark, sf_dir):
    return metrics.query_metrics(*_rankings(spark, sf_dir)).select("query", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"{_METRICS} SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per_query")
def eval_means(spark, sf_dir):
    return metrics.mean_metrics(metrics.query_metrics(*_rankings(spark, sf_dir))).select(*[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"""WITH {_RANKED}, met AS (SELECT e.query, e.id::VARCHAR AS id, r.rank FROM expected e LEFT JOIN ranked r ON r.query = e.query AND r.id = e.id AND r.rank <= 10)
SELECT query, coalesce(string_agg(id || '@' || rank, ',' ORDER BY id || '@' || rank) FILTER (rank IS NOT NULL), '') AS found,
       coalesce(string_agg(id, ',' ORDER BY id) FILTER (rank IS NULL), '') AS missed FROM met GROUP BY query""")
def eval_missed_and_found(spark, sf_dir):
    out = metrics.missed_and_found(*_rankings(spark, sf_dir))
    return out.select("query", F.array_join("found", ",").alias("found"), F.array_join("missed", ",").alias("missed"))


@query("SELECT DISTINCT l.doc_id::VARCHAR AS query, l.doc_id AS id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id)")
def eval_unknown_expected(spark, sf_dir):
    expected = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query"), F.col("doc_id").alias("id"))
    return metrics.unknown_expected(expected, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
