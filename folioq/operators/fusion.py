"""Fusion of a full-text and a dense ranking, five ways. Ranks start at 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, DENSE_K = 60, 10
FTS_WEIGHT, WEAK_SHARE = 0.4, 0.5
FIRST_FTS = 0.5
CONVEX_DENSE, CONVEX_FTS = 0.7, 0.3


def _ranked(hits: DataFrame, name: str) -> DataFrame:
    """Candidate lists are short (top-k); they are ranked in one task."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1
    return hits.select("id", F.col("score").alias(f"{name}_score"), place.alias(f"{name}_rank"))


def _joined(fts: DataFrame, dense: DataFrame) -> DataFrame:
    return _ranked(fts, "fts").join(_ranked(dense, "dense"), "id", "full")


def _part(weight: float, k: int, rank: str):
    return F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))


def rrf(fts: DataFrame, dense: DataFrame, fts_weight: float = 1.0) -> DataFrame:
    return _joined(fts, dense).select("id", (_part(fts_weight, RRF_K, "fts_rank") + _part(1.0, RRF_K, "dense_rank")).alias("score"))


def weighted_rrf(fts: DataFrame, dense: DataFrame) -> DataFrame:
    return rrf(fts, dense, FTS_WEIGHT)


def weak_fts_ignored(fts: DataFrame, dense: DataFrame) -> DataFrame:
    """Full-text hits under half of the best are dropped, then ranked."""
    best = F.max("score").over(Window.partitionBy())
    return rrf(fts.withColumn("best", best).where(F.col("score") >= WEAK_SHARE * F.col("best")).drop("best"), dense)


def convex(fts: DataFrame, dense: DataFrame) -> DataFrame:
    every = Window.partitionBy()

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(every), F.max("score").over(every)
        return hits.select("id", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias(name))

    both = scaled(fts, "f").join(scaled(dense, "d"), "id", "full")
    return both.select("id", (CONVEX_DENSE * F.coalesce("d", F.lit(0.0)) + CONVEX_FTS * F.coalesce("f", F.lit(0.0))).alias("score"))


def dense_first(fts: DataFrame, dense: DataFrame, top_k: int) -> DataFrame:
    """Rows (id, score, place): the dense top-k reordered with the full text's help, then the other dense hits, then the rest.

    Scores are capped so that they never rise along the list.
    """
    both = _joined(fts, dense)
    has_dense = F.col("dense_rank").isNotNull()
    zone = F.when(F.col("dense_rank") < top_k, 0).when(has_dense, 1).otherwise(2)
    raw = F.when(has_dense, _part(1.0, DENSE_K, "dense_rank")).otherwise(F.lit(0.0)) + _part(FIRST_FTS, RRF_K, "fts_rank")
    order = Window.orderBy("zone", F.desc("raw"), F.coalesce("dense_rank", "fts_rank"))
    out = both.select("id", zone.alias("zone"), raw.alias("raw"), "dense_rank", "fts_rank").withColumn("place", F.row_number().over(order))
    return out.select("id", F.min("raw").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("score"), "place")
