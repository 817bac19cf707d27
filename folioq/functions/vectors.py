"""Vectors as array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_HELD = 4096


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; the cosine for unit vectors."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def mean_vectors(vectors: DataFrame, by: str, vector: str = "embedding", order: str | None = None) -> DataFrame:
    """Rows (by, embedding): the unit vector of the element-wise sum; groups without length have none.

    Tasks sum up whole vectors of a key first, so one vector of each task and key is shuffled.
    The first row of a group with a vector, by order, fixes its dimension (without order, or for ties, the smallest); others are passed over.
    """
    place = F.col(order) if order else F.lit(0)
    sized = vectors.select(by, vector, F.size(vector).alias("dim"), place.alias("place")).where("dim > 0")
    dims = sized.groupBy(by).agg(F.min(F.struct("place", "dim"))["dim"].alias("dim"))
    rows = sized.join(dims, [by, "dim"]).select(by, F.col(vector).cast("array<double>").alias("embedding"))
    kind = rows.schema[by].dataType.simpleString()
    parts = rows.mapInArrow(_partly_summed, f"{by} {kind}, embedding array<double>")
    return parts.repartition(by).sortWithinPartitions(by).mapInArrow(_summed, f"{by} {kind}, embedding array<double>")


def _batch(like: pa.RecordBatch, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], like.schema.field(0).type), pa.array([v for _, v in sums], pa.list_(pa.float64()))], names=like.schema.names)


def _rows(batch: pa.RecordBatch):
    """Keys and vectors of a batch."""
    lists = batch.column(1)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    yield from zip(batch.column(0).to_pylist(), np.split(values, ends[:-1]) if len(ends) else [], strict=True)


def _partly_summed(batches):
    """A vector for each key that a task has at a time."""
    held: dict = {}
    for batch in batches:
        for key, v in _rows(batch):
            held[key] = held[key] + v if key in held else v
        if len(held) > KEYS_HELD:
            yield _batch(batch, list(held.items()))
            held = {}
        last = batch
    if held:
        yield _batch(last, list(held.items()))


def _summed(batches):
    """batches in order of their key. The unit vector of each key's sum."""
    now, last = None, None
    for batch in batches:
        done = []
        for key, v in _rows(batch):
            if now is not None and now[0] == key:
                now = key, now[1] + v
            else:
                done += [now] if now else []
                now = key, v
        last = batch
        yield _batch(batch, [(k, v / n) for k, v in done if (n := np.sqrt(v @ v)) > 1e-7])
    if now and (n := np.sqrt(now[1] @ now[1])) > 1e-7:
        yield _batch(last, [(now[0], now[1] / n)])


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for vectors of different sizes or without length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def hashed_embeddings(rows: DataFrame, by: str, tokens: str, dim: int = 1024) -> DataFrame:
    """Sparse unit vectors by feature hashing, as rows (by, at, x): each token of two bytes or more adds +1 or -1 to one of dim places."""
    each = rows.select(by, tokens).repartition(by).select(by, F.explode(tokens).alias("t")).where(F.octet_length("t") >= 2)
    sign = F.when(F.xxhash64("t", F.lit(2)).bitwiseAND(1) == 1, 1).otherwise(-1)
    sums = each.groupBy(by, F.pmod(F.xxhash64("t", F.lit(1)), F.lit(dim)).cast("int").alias("at")).agg(F.sum(sign).alias("x")).where("x <> 0")
    lists = sums.groupBy(by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.collect_list(F.struct("at", "x")).alias("p"))  # dim places at most
    return lists.select(by, "length", F.explode("p").alias("p")).select(by, "p.at", (F.col("p.x") / F.col("length")).alias("x"))
