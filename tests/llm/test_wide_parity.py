"""Parities of long texts pass every similar pair on and tell others apart without their windows."""

import numpy as np


def test_closer(spark):
    from folioq.llm.jaccard import closer, wide

    r = np.random.default_rng(3)
    rows, near, far = [], [], []
    for i, (n, gone, new) in enumerate([(1000, 20, 60), (1024, 0, 1), (2040, 90, 100), (5000, 200, 250), (20, 0, 1), (250, 5, 12), (4096, 400, 0)]):
        x = r.integers(0, 1 << 64, n, np.uint64)
        y = np.concatenate((x[gone:], r.integers(0, 1 << 64, new, np.uint64)))
        assert 100 * (n - gone) >= 90 * (n + new)
        other = r.integers(0, 1 << 64, n, np.uint64)
        rows += [(3 * i + k, len(h), wide(h)) for k, h in enumerate((x, y, other))]
        near.append((3 * i, 3 * i + 1))
        far.append((3 * i, 3 * i + 2))
    classes = spark.createDataFrame(rows, "class long, size long, wide array<long>")
    pairs = spark.createDataFrame(near + far + [(6, 12)], "a long, b long")  # sizes of more than twice: left to the exact check
    assert sorted(map(tuple, closer(pairs, classes, 90).collect())) == sorted([*near, (6, 12)])
