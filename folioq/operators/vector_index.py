"""Nearest vectors by inverted lists, exact whatever the lists look like.

Centroids are fitted on SAMPLE vectors (those of the smallest hash of their id), every vector
goes to the list of its nearest centroid, in order of its distance to it. By the triangle
inequality a vector of a list is no nearer to a query than the query's and its own distance to the
centroid differ. A search reads the PROBES lists nearest to the query first; the k-th distance
found bounds the answer, and of the other lists those that can hold something nearer are read, and in them the
vectors whose distance to the centroid lies within the bound. Vectors of another size than
most of the sample stand in a list of their own and are compared in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.store import scratch

SAMPLE, MOST_LISTS, ROUNDS, PROBES, SALTS = 20_000, 4096, 8, 4, 16
OTHER = -1  # the list of vectors of another size
SLACK = 1e-5  # distances are rounded to six places


@dataclass(frozen=True)
class VectorIndex:
    """vectors: (id, ..., embedding, own: distance to the list's centroid, list). radii: the greatest distance, and number of vectors, of each list."""

    vectors: DataFrame
    centroids: np.ndarray
    radii: dict[int, tuple[float, int]]


def fitted(points: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of points: rounds of nearest-centroid means from evenly chosen points; an empty list takes the point farthest from its own."""
    centroids = points[np.linspace(0, len(points) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest, far = assigned(points, centroids)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = points[np.argsort(-far)[: len(empty)]]
    return centroids


def assigned(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, and the distance to it."""
    squares = (centroids * centroids).sum(axis=1)
    nearest = np.concatenate([(squares - 2 * points[at : at + 4096] @ centroids.T).argmin(axis=1) for at in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)
    return nearest, np.sqrt(((points - centroids[nearest]) ** 2).sum(axis=1))


def build(rows: DataFrame, id_col: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """rows: the vectors with what else is to be found with them. lists, unset, is the square root of their number."""
    spark = rows.sparkSession
    taken = rows.where(F.size(vector) > 0).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).collect()  # sample rows at most
    sizes = pd.Series([len(r["v"]) for r in taken])
    dim = int(sizes.mode().iloc[0]) if len(sizes) else 1
    points = np.array([r["v"] for r in taken if len(r["v"]) == dim], float).reshape(-1, dim)
    lists = lists or min(MOST_LISTS, math.isqrt(rows.count()) + 1)
    centroids = fitted(points, min(lists, len(points))) if len(points) else np.zeros((1, dim))

    def dealt(vectors: pd.Series) -> pd.DataFrame:
        fits = vectors.map(lambda v: v is not None and len(v) == dim).to_numpy(bool)
        out = pd.DataFrame({"list": np.full(len(vectors), OTHER), "own": np.zeros(len(vectors))})
        if fits.any():
            nearest, own = assigned(np.stack(vectors[fits].to_list()).astype(float), centroids)
            out.loc[fits, "list"], out.loc[fits, "own"] = nearest, own
        return out

    deal = F.pandas_udf(dealt, "list int, own double")
    placed = rows.withColumn("p", deal(F.col(vector))).select(*rows.columns, "p.own", "p.list")
    path = scratch(spark, "vectors")
    placed.repartition("list", F.pmod(F.xxhash64(id_col), F.lit(SALTS))).sortWithinPartitions("list", "own").write.partitionBy("list").option("compression", "zstd").parquet(path)
    vectors = spark.read.schema(placed.schema).parquet(path)
    radii = {r["list"]: (r["r"], r["n"]) for r in vectors.groupBy("list").agg(F.max("own").alias("r"), F.count("*").alias("n")).collect()}  # a row for each list
    return VectorIndex(vectors, centroids, radii)


def _scored(rows: DataFrame, query: np.ndarray, vector: str) -> DataFrame:
    """rows with a score: minus the distance to query, to six places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.aggregate(F.zip_with(vector, q, lambda x, y: x.cast("double") - y), F.lit(0.0), lambda s, x: s + x * x)
    return rows.where(F.size(vector) == len(query)).withColumn("score", F.round(-F.sqrt(squares), 6))


def nearest(index: VectorIndex, query: list[float], k: int, order: str, vector: str = "embedding", probes: int = PROBES) -> tuple[DataFrame, dict[str, int]]:
    """The k rows nearest to query, equal scores by order; and how many lists and vectors of how many there was reason to read."""
    q = np.array(query, float)
    columns = [c for c in index.vectors.columns if c not in ("own", "list")]
    if len(q) != index.centroids.shape[1]:
        lists, keep = [OTHER], F.lit(True)
    else:
        away = np.sqrt(((index.centroids - q) ** 2).sum(axis=1))
        known = sorted((x for x in index.radii if x != OTHER), key=lambda x: away[x])
        first, n = known[:probes], sum(index.radii[x][1] for x in known[:probes])
        while n < k and len(first) < len(known):
            first, n = known[: 2 * len(first)], sum(index.radii[x][1] for x in known[: 2 * len(first)])
        best = _scored(index.vectors.where(F.col("list").isin(first)), q, vector).select("score").orderBy(F.desc("score")).limit(k).collect()
        bound = -best[-1]["score"] + SLACK if len(best) == k else math.inf
        lists = [x for x in known if away[x] - index.radii[x][0] <= bound]
        own = F.col("own")
        at = F.element_at(F.create_map(*[y for x in lists for y in (F.lit(x), F.lit(float(away[x])))]), F.col("list")) if lists else F.lit(0.0)
        keep = F.lit(True) if math.isinf(bound) or not lists else (own >= at - bound) & (own <= at + bound) & (own >= float(min(away[x] for x in lists)) - bound)
    read = index.vectors.where(F.col("list").isin(lists) & keep)
    found = _scored(read, q, vector).orderBy(F.desc("score"), order).limit(k).select(*columns, "score")
    return found, {"lists": len(lists), "of_lists": len(index.radii), "vectors_in_lists": sum(index.radii[x][1] for x in lists if x in index.radii), "of_vectors": sum(n for _, n in index.radii.values())}
