"""Retrieval quality of an evaluation set: every mode, every fusion, what was missed, and what was skipped.

    python -m folioq.evaluate VAULT SET [CHUNKS [PAGE_VECTORS]]

SET: Parquet of (id, query, expected, vector). CHUNKS: Parquet of (chunk_id, page_id, embedding), whose vectors are of the set's
model; without them every chunk of the vault and every query gets a vector of hashed words. PAGE_VECTORS: Parquet of (page_id,
embedding), or else the mean vectors of the chunks.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.text import tokens
from folioq.functions.vectors import hashed_embeddings, mean_vectors
from folioq.operators import chunks, metrics, search
from folioq.store import stored


def skipped(entries: DataFrame) -> DataFrame:
    """Entries that expect nothing: they are left out and listed."""
    return entries.where(F.size(F.coalesce("expected", F.array().cast("array<string>"))) == 0).select("id")


def evaluated(base, entries: DataFrame, limit: int = metrics.CUT) -> dict[str, DataFrame]:
    """base: a KnowledgeBase. modes, fusions, per_query, missed and skipped of the set; a set is a short list that the driver holds."""
    kept = entries.where(F.size("expected") > 0)
    expected = kept.select(F.col("id").alias("query"), F.explode("expected").alias("id"))
    lists = [(r["id"], search.text_candidates(base.index, r["query"]), search.dense_candidates(base.chunks, F.array(*map(F.lit, r["vector"])))) for r in kept.collect()]
    if not lists:
        return {"skipped": skipped(entries)}
    ranked = reduce(DataFrame.unionByName, [search.modes(text, dense, limit).select("mode", F.lit(q).alias("query"), "id", F.col("place").alias("rank")) for q, text, dense in lists])
    of = lambda mode: metrics.query_metrics(ranked.where(F.col("mode") == mode), expected)
    modes = reduce(DataFrame.unionByName, [metrics.mean_metrics(of(m)).select(F.lit(m).alias("mode"), "recall", "mrr", "ndcg") for m in search.MODES])
    return {
        "modes": modes,
        "fusions": search.fusion_comparison(lists, expected, limit),
        "per_query": of("hybrid"),
        "missed": metrics.missed_and_found(ranked.where("mode = 'hybrid'"), expected),
        "unknown": metrics.unknown_expected(expected, base.pages),
        "skipped": skipped(entries),
    }


def hashed_chunks(pages: DataFrame, dim: int = 256) -> DataFrame:
    """Chunks (chunk_id, page_id, embedding) of the pages with vectors of their hashed words, for a vault without a model."""
    cut = chunks.section_chunks(pages).withColumn("chunk_id", F.concat_ws("#", "id", "chunk_idx"))
    return with_hashed(cut.withColumnRenamed("id", "page_id"), "chunk_id", "chunk", dim).select("chunk_id", "page_id", "embedding")


def with_hashed(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """rows with the hashed-word vector of a text as embedding, all zero without words."""
    sparse = hashed_embeddings(rows.select(key, tokens(F.col(text)).alias("words")), key, "words", dim)
    held = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("held"))  # dim entries at most
    whole = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0)))
    return rows.join(held.select(key, whole.alias("embedding")), key, "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)))


def opened(spark: SparkSession, vault_folder: str, set_file: str, chunk_file: str | None = None, vector_file: str | None = None):
    """The knowledge base of a vault and its evaluation set, both with vectors."""
    from folioq.knowledge_base import KnowledgeBase
    from folioq.sources import vault

    pages, entries = vault.read_pages(spark, vault_folder), spark.read.parquet(set_file)
    if chunk_file:
        rows = spark.read.parquet(chunk_file)
    else:
        rows = stored(hashed_chunks(pages), "chunks")
        entries = with_hashed(entries.drop("vector"), "id", "query").withColumnRenamed("embedding", "vector")
    means = spark.read.parquet(vector_file) if vector_file else mean_vectors(rows, "page_id", order="chunk_id")
    access = spark.createDataFrame([], "page_id string, reads long, search_hits long, last_read_at timestamp")
    return KnowledgeBase(pages, access, rows, means, lambda q: F.array().cast("array<double>")), entries


def main(*files: str) -> None:
    from folioq.session import session

    base, entries = opened(session("local[*]"), *files)
    for name, rows in evaluated(base, entries).items():
        print(name)
        rows.show(100, False)


if __name__ == "__main__":
    main(*sys.argv[1:])
