"""All pairs of similar vectors of a type, by pivots and the triangle inequality.

Vectors whose product reaches a threshold lie within a distance that follows from the
threshold and the greatest length. Each vector is at home with its nearest pivot, and is a guest
with every pivot that is no farther than its own by twice that distance: so of two similar vectors
each is a guest where the other is at home. Homes and guests of a pivot and type meet in cells of
PIECE rows each, so no task has a pivot's vectors to itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.operators.vector_index import SAMPLE, fitted
from folioq.store import stored

MOST_PIVOTS = 1024
PIECE = 2048
OUT = 4096
MOST_SHARE = 0.5
SLACK = 1e-6  # products are rounded to six places


def _stacked(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of dim numbers, shorter ones filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lists) and (sizes == dim).all():
        return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists.to_pylist()):
        out[i, : len(v)] = v
    return out


def cell_pairs(threshold: float, of_guest: tuple[str, ...] = ()):
    """Gives for a cell of rows (id, v, home, ...) the pairs (x, y, similarity) of a home and a guest of threshold at least, with columns of_guest of the guest."""

    def multiplied(cell: pa.Table) -> pa.Table:
        left, right = cell.filter(cell.column("home")), cell.filter(pc.invert(cell.column("home")))
        i = j = np.zeros(0, int)
        found = np.zeros(0)
        if left.num_rows and right.num_rows:
            dim = pc.max(pc.list_value_length(cell.column("v"))).as_py()
            a, b = (_stacked(t.column("v").combine_chunks(), dim) for t in (left, right))
            products = np.round(a @ b.T, 6)
            i, j = np.nonzero(products >= threshold)
            found = products[i, j]
        return pa.table({"x": left.column("id").take(pa.array(i)), "y": right.column("id").take(pa.array(j)), "similarity": pa.array(found), **{c: right.column(c).take(pa.array(j)) for c in of_guest}})

    return multiplied


def similar_pairs(vectors: DataFrame, threshold: float, pivots: int | None = None, sample: int = SAMPLE, piece: int = PIECE) -> DataFrame:
    """vectors: (id, type, embedding). Rows (a, b, similarity), a < b, of all pairs of a type whose product, to six places, is threshold at least (which is above 0)."""
    rows = stored(vectors.where("type is not null and id is not null and size(embedding) > 0").select("id", "type", F.col("embedding").cast("array<double>").alias("v")), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity"))
    near = math.sqrt(max(0.0, 2 * most - 2 * (threshold - SLACK))) + 1e-9
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # sample rows at most
    points = np.zeros((len(taken), dim))
    for i, r in enumerate(taken):
        points[i, : len(r["v"])] = r["v"]
    centres = fitted(points, min(len(points), pivots or min(MOST_PIVOTS, math.isqrt(n) + 1)))
    lengths = (centres * centres).sum(axis=1)
    far = np.sqrt(np.maximum(0, (points[:1000] ** 2).sum(axis=1)[:, None] + lengths - 2 * points[:1000] @ centres.T))
    if (far <= far.min(axis=1)[:, None] + 2 * near).mean() > MOST_SHARE:  # a low threshold makes guests of most vectors everywhere: cells alone are less
        centres, lengths = centres[:1], lengths[:1]

    def housed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = _stacked(part.column(2), dim)
                away = np.sqrt(np.maximum(0, (v * v).sum(axis=1)[:, None] + lengths - 2 * v @ centres.T))
                home = away.argmin(axis=1)
                row, pivot = np.nonzero(away <= away.min(axis=1)[:, None] + 2 * near + 1e-6)
                for out in range(0, len(row), OUT):
                    r, p = row[out : out + OUT], pivot[out : out + OUT]
                    yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(r)) for i in range(3)), pa.array(p), pa.array(home[r] == p)], names=["id", "type", "v", "pivot", "home"])

    dealt = rows.mapInArrow(housed, f"id {of['id']}, type {of['type']}, v array<double>, pivot long, home boolean")
    dealt = stored(dealt, "housed")
    sizes = dealt.groupBy("type", "pivot").agg(F.ceil(F.count_if("home") / piece).cast("int").alias("homes"), F.ceil(F.count("*") / piece).cast("int").alias("guests"))
    met = dealt.join(sizes.where("homes > 0"), ["type", "pivot"])
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = met.where("home").withColumns({"i": own("homes"), "j": every("guests")}).select("type", "pivot", "i", "j", "id", "v", "home")
    guests = met.withColumns({"j": own("guests"), "i": every("homes")}).select("type", "pivot", "i", "j", "id", "v", F.lit(False).alias("home"))

    pairs = homes.unionByName(guests).groupBy("type", "pivot", "i", "j").applyInArrow(cell_pairs(threshold), f"x {of['id']}, y {of['id']}, similarity double")
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
