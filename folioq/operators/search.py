"""Search as its users call it: modes, fused hits with title, path and snippet, and what happens without hits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions.text import plain_tokens, tokens
from folioq.functions.vectors import cosine
from folioq.operators import fulltext, fusion, metrics
from folioq.store import stored

CANDIDATES, CHUNKS = 50, 200
LIMIT, MOST = 10, 20
#: Weights of the indexed fields.
WEIGHTS = {"title": 3.0, "body": 1.0, "summary": 5.0}
MODES = ("fts-only", "dense-only", "hybrid")
FUSIONS = {"rrf": fusion.rrf, "weighted-rrf": fusion.weighted_rrf, "weak-fts-ignored": fusion.weak_fts_ignored, "dense-first": None, "convex": fusion.convex}


def clamped(limit: int | None, default: int = LIMIT, most: int = MOST) -> int:
    return min(most, max(1, default if limit is None else limit))


def text_candidates(index: fulltext.Index, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """The best CANDIDATES (id, score) by BM25; ties by id."""
    terms = fulltext.query_terms(query)
    return fulltext.bm25(index, weights or WEIGHTS, terms).orderBy(F.desc("score"), "id").limit(CANDIDATES)


def dense_candidates(chunks: DataFrame, vector: Column) -> DataFrame:
    """chunks: (chunk_id, page_id, embedding). Pages (id, score) of the nearest CHUNKS chunks by distance, each with its best one.

    Vectors of another size than the query's are passed over.
    """
    difference = F.zip_with("embedding", vector, lambda x, y: x.cast("double") - y)
    distance = F.sqrt(F.aggregate(difference, F.lit(0.0), lambda s, x: s + x * x))
    near = chunks.where(F.size("embedding") == F.size(vector)).select("chunk_id", "page_id", F.round(-distance, 6).alias("score"))
    return near.orderBy(F.desc("score"), "chunk_id").limit(CHUNKS).groupBy(F.col("page_id").alias("id")).agg(F.max("score").alias("score"))


def dense_over(chunks: DataFrame, vector: Column, candidates: DataFrame | None = None) -> DataFrame:
    """Pages (id, score) by the cosine of their best chunk: of the candidates, or of all pages."""
    rows = chunks if candidates is None else chunks.join(F.broadcast(candidates.select(F.col("id").alias("page_id"))), "page_id", "left_semi")  # CANDIDATES at most
    return rows.groupBy(F.col("page_id").alias("id")).agg(F.round(F.max(cosine("embedding", vector)), 6).alias("score")).where("score is not null")


def fused(text: DataFrame, dense: DataFrame, name: str = "dense-first", limit: int = LIMIT) -> DataFrame:
    """Rows (id, score, place) of one of FUSIONS, the first limit of them."""
    if name == "dense-first":
        return fusion.dense_first(text, dense, limit).where(F.col("place") <= limit)
    best = FUSIONS[name](text, dense).orderBy(F.desc("score"), "id").limit(limit)
    return _placed(best)


def _placed(hits: DataFrame) -> DataFrame:
    """hits are a short list: limit rows at most."""
    return fusion._ranked(hits, "x").select("id", F.col("x_score").alias("score"), (F.col("x_rank") + 1).alias("place"))


def modes(text: DataFrame, dense: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (mode, id, score, place): the same candidates ranked by text, by vectors and by both."""
    parts = zip(MODES, (_placed(text).where(F.col("place") <= limit), _placed(dense).where(F.col("place") <= limit), fused(text, dense, limit=limit)), strict=True)
    return reduce(DataFrame.unionByName, [hits.select(F.lit(mode).alias("mode"), "id", "score", F.col("place").cast("int").alias("place")) for mode, hits in parts])


def attached(hits: DataFrame, pages: DataFrame, query: str, text: DataFrame) -> DataFrame:
    """hits with title (else the id), path and, for hits of the text search, a snippet of the field with the most different query words."""
    words = sorted({w for t in fulltext.query_terms(query) for w in plain_tokens(t)})
    shown = pages.join(F.broadcast(hits), "id", "right").join(F.broadcast(text.select("id", F.lit(True).alias("by_text"))), "id", "left")
    held = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    fields = [F.struct(F.size(F.array_intersect(tokens(F.col(c)), held)).alias("n"), F.lit(-i).alias("first"), F.col(c).alias("text")) for i, c in enumerate(("title", "body", "summary"))]
    best = F.array_max(F.array(*fields))["text"]
    snippet = F.when(F.col("by_text"), fulltext.limited_markers(fulltext.best_window(tokens(best), words))) if words else F.lit("")
    return shown.select("place", "id", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(snippet, F.lit("")).alias("snippet"), "score").orderBy("place")


def brute_force(pages: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Pages that hold the query as it stands; used where the index finds nothing."""
    scored = fulltext.substring_scores(pages, query.strip(), "title", "body").orderBy(F.desc("score"), "id").limit(limit)
    placed = _placed(scored.withColumn("score", F.col("score").cast("double")))
    found = pages.join(F.broadcast(placed), "id")
    return found.select("place", "id", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(fulltext.around(F.col("body"), query.strip()), F.lit("")).alias("snippet"), "score").orderBy("place")


def search(pages: DataFrame, index: fulltext.Index, chunks: DataFrame, query: str, vector: Column, limit: int | None = None) -> DataFrame:
    """Rows (place, id, title, path, snippet, score): none for a blank query; fused hits, or where there are none, those of brute_force."""
    limit = clamped(limit)
    if not query.strip():
        return brute_force(pages.where("false"), "x", limit)
    text = stored(text_candidates(index, query), "candidates")  # short lists, each read several times
    hits = stored(fused(text, stored(dense_candidates(chunks, vector), "candidates"), limit=limit), "hits")
    if hits.isEmpty():
        return brute_force(pages, query, limit)
    return attached(hits, pages, query, text)


def fusion_comparison(candidates: list[tuple[str, DataFrame, DataFrame]], expected: DataFrame, limit: int = metrics.CUT) -> DataFrame:
    """candidates: for each query its name, text and dense candidates; expected: (query, id). Rows (fusion, recall, mrr, ndcg): means over the queries that expect something."""
    candidates = [(q, stored(text, "candidates"), stored(dense, "candidates")) for q, text, dense in candidates]
    parts = []
    for name in FUSIONS:
        ranked = reduce(DataFrame.unionByName, [fused(text, dense, name, limit).select(F.lit(query).alias("query"), "id", F.col("place").alias("rank")) for query, text, dense in candidates])
        parts.append(metrics.mean_metrics(metrics.query_metrics(ranked, expected)).select(F.lit(name).alias("fusion"), "recall", "mrr", "ndcg"))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Embedders:
    """Which embedder made the index's vectors, and which the query's."""

    index: str | None
    query: str

    def warning(self) -> str | None:
        if self.index == self.query:
            return None
        return f"the index holds vectors of {self.index or 'an unknown embedder'}, the query has one of {self.query}: dense and hybrid results mean nothing until both agree"
