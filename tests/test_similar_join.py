"""Similar pairs by pivots against all pairs, of clusters, of equal vectors, and of a large type."""

import numpy as np
from pyspark.sql import functions as F

from folioq.operators.similar_join import similar_pairs


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def every(ids, types, vectors, threshold):
    products = np.round(vectors @ vectors.T, 6)
    i, j = np.nonzero(np.triu(products >= threshold, 1))
    return {(int(ids[a]), int(ids[b]), float(products[a, b])) for a, b in zip(i, j, strict=True) if types[a] == types[b]}


def test_small(spark):
    r = np.random.default_rng(1)
    centres = unit(r.normal(size=(25, 6)))
    v = unit(centres[r.integers(0, 25, 900)] + 0.12 * r.normal(size=(900, 6)))
    v[100:140] = v[100]
    v[200] = 0
    v[300] *= 2
    types = ["x" if i % 3 else "y" for i in range(900)]
    rows = [(i, types[i], v[i].tolist()) for i in range(900)] + [(900, "x", None), (901, None, v[1].tolist()), (902, "x", [])]
    frame = spark.createDataFrame(rows, "id long, type string, embedding array<double>").repartition(4)
    wanted = every(range(900), types, v, 0.92)
    for options in ({}, {"pivots": 1, "piece": 50}, {"pivots": 40, "piece": 7, "sample": 100}):
        got = {(x["a"], x["b"], x["similarity"]) for x in similar_pairs(frame, 0.92, **options).collect()}
        assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in wanted}
        assert all(abs(s - dict(((a, b), t) for a, b, t in wanted)[x, y]) < 2e-6 for x, y, s in list(got)[:50])
    assert similar_pairs(frame.where("false"), 0.92).count() == 0


def test_a_type_of_twenty_thousand(spark):
    r = np.random.default_rng(2)
    centres = unit(r.normal(size=(4000, 32)))
    v = unit(centres[np.arange(20_000) % 4000] + 0.04 * r.normal(size=(20_000, 32)))
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(20_000), "type": "t", "embedding": v.tolist()}))
    wanted = sum(int(np.triu(np.round(v[at : at + 1000] @ v.T, 6) >= 0.92, at + 1).sum()) for at in range(0, 20_000, 1000))
    assert similar_pairs(frame, 0.92).count() == wanted > 20_000


def test_low_thresholds(spark, monkeypatch):
    """Where most vectors would be guests of most pivots, each is dealt once; batches stay small."""
    from folioq.operators import similar_join

    points = np.random.default_rng(5).normal(size=(400, 8))
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    frame = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(points)], "id long, type int, embedding array<double>")
    dealt = {}
    keep = similar_join.stored
    monkeypatch.setattr(similar_join, "stored", lambda df, name: dealt.setdefault(name, keep(df, name)))
    got = {(r["a"], r["b"]) for r in similar_pairs(frame, 0.4).collect()}
    products = np.round(points @ points.T, 6)
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if i % 2 == j % 2 and products[i, j] >= 0.4}
    assert dealt["housed"].count() == 400


def test_asked_rows_in_pieces(spark, monkeypatch):
    """Asked rows of a large type against all of it, all pairs of a small one, once each, however they are cut."""
    from folioq.operators import names

    points = np.random.default_rng(6).normal(size=(120, 4))
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    kind = lambda i: "small" if i < 20 else "large"
    frame = spark.createDataFrame([(i, kind(i), v.tolist()) for i, v in enumerate(points)] + [(120, "small", None)], "id long, type string, embedding array<double>")
    monkeypatch.setattr(names, "PIECE", 9)
    pairs, notes = names.content_pairs(frame, 0.5, 30, F.col("id") % 10 == 0)
    products = np.round(points @ points.T, 6)
    wanted = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if kind(i) == kind(j) and products[i, j] >= 0.5 and (i < 20 or not i % 10 or not j % 10))
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == wanted and [tuple(r) for r in notes.collect()] == [("large", 100)]
