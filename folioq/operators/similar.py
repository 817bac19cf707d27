"""Pages like a page, by their page vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.functions.vectors import cosine, mean_vectors

LIMIT, MOST = 8, 50


def target_vector(page_vectors: DataFrame, chunks: DataFrame, page_id: str) -> DataFrame:
    """One row (vector) or none: the page's own vector, else the mean of its chunks' vectors in their order."""
    own = page_vectors.where(F.col("page_id") == page_id).select(F.lit(0).alias("rank"), F.col("embedding").cast("array<double>").alias("vector")).where("size(vector) > 0")
    mean = mean_vectors(chunks.where(F.col("page_id") == page_id), "page_id", order="chunk_id").select(F.lit(1).alias("rank"), F.col("embedding").alias("vector"))
    return own.unionByName(mean).orderBy("rank").limit(1).select("vector")


def similar(page_vectors: DataFrame, chunks: DataFrame, pages: DataFrame, page_id: str, limit: int = LIMIT) -> DataFrame:
    """Rows (id, title, type, score): the pages nearest to page_id by cosine, without itself and those it says it is distinct from; ties by id."""
    apart = pages.where(F.col("id") == page_id).select(F.explode(F.coalesce("distinct_from", F.array().cast("array<string>"))).alias("page_id"))
    target = F.broadcast(target_vector(page_vectors, chunks, page_id))  # one row
    rows = page_vectors.where(F.col("page_id") != page_id).join(F.broadcast(apart), "page_id", "left_anti").join(target)  # apart is one page's list
    scored = rows.select(F.col("page_id").alias("id"), F.round(cosine("embedding", "vector"), 6).alias("score")).where("score is not null")
    known = scored.join(pages.select("id", "title", "type"), "id")
    return known.select("id", "title", "type", "score").orderBy(F.desc("score"), "id").limit(min(MOST, max(1, limit)))
