"""Inverted lists against a full scan, for vectors in groups, equal ones, and of other sizes."""

import numpy as np

from folioq.operators import vector_index


def frame(spark, n=3000):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 8)) * 5
    points = [(centres[i % 30] + r.normal(size=8)).tolist() for i in range(n)]
    points[10:60] = [points[10]] * 50
    rows = [(i, p, "x") for i, p in enumerate(points)] + [(n, [1.0, 2.0], "x"), (n + 1, None, "x"), (n + 2, [], "x"), (n + 3, [1.0, 2.5], "x")]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>, list_of string")


def scan(rows, query, k):
    found = [(-round(float(np.sqrt(((np.array(v) - query) ** 2).sum())), 6), i) for i, v, _ in rows if v is not None and len(v) == len(query)]
    return [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


def test_nearest(spark):
    rows, df = frame(spark)
    index = vector_index.build(df, "id", lists=40, sample=1000)
    assert sum(n for _, n in index.radii.values()) == len(rows)
    for query, k in ((rows[10][1], 70), (rows[5][1], 5), ([0.0] * 8, 20), (rows[7][1], 5000), ([1.0, 2.0], 5), ([1.0] * 3, 4)):
        found, read = vector_index.nearest(index, query, k, "id")
        got = [(r["id"], r["score"]) for r in found.collect()]
        want = scan(rows, np.array(query), k)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)
        if k == 5 and len(query) == 8:
            assert read["lists"] < 0.5 * read["of_lists"] and read["vectors_in_lists"] < 0.5 * read["of_vectors"]
    empty = vector_index.build(df.where("false"), "id")
    assert vector_index.nearest(empty, [1.0], 3, "id")[0].count() == 0
