"""Retrieval quality: Recall@10, MRR and nDCG@10 of rankings against expected ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 10


def query_metrics(ranked: DataFrame, expected: DataFrame, cut: int = CUT) -> DataFrame:
    """ranked: (query, id, rank from 1); expected: (query, id). Rows (query, recall, mrr, ndcg) of queries that expect something."""
    wanted = expected.select("query", "id").distinct()
    met = wanted.join(ranked.where(F.col("rank") <= cut).groupBy("query", "id").agg(F.min("rank").alias("rank")), ["query", "id"], "left")
    gain = F.coalesce(1 / F.log2(F.col("rank") + 1.0), F.lit(0.0))
    sums = met.groupBy("query").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(cut)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return sums.select("query", (F.col("found") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "mrr", "ndcg")])


def missed_and_found(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (query, found as 'id@rank', missed), each list in order of id."""
    best = ranked.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    met = expected.select("query", "id").distinct().join(best, ["query", "id"], "left")
    found = F.collect_list(F.when(F.col("rank").isNotNull(), F.concat_ws("@", "id", "rank")))
    missed = F.collect_list(F.when(F.col("rank").isNull(), F.col("id").cast("string")))
    return met.groupBy("query").agg(F.sort_array(found).alias("found"), F.sort_array(missed).alias("missed"))


def unknown_expected(expected: DataFrame, pages: DataFrame) -> DataFrame:
    return expected.select("query", "id").distinct().join(pages.select("id"), "id", "left_anti")
