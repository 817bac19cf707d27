"""Ranked search against a plain version that scores every document."""

import math
import random
import re

import numpy as np

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    found = [(d, t) for d, text in docs if (t := split(text))]
    n, length = len(found), sum(len(t) for _, t in found)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, wanted in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t in wanted if (df := sum(t in x for _, x in found))}
        scored = []
        for d, t in found:
            m = 50 + 50 * len(t) * n // length
            s = sum(w * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x, w in weights.items() if x in t)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out.append((item, rank, d, -s))
    return out


def tables():
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(120)] + ["Été", "Ω", "ΣΑ", "a_b", "X-1"]
    chances = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, chances, k=r.randint(1, 60)))) for i in range(700)]
    docs += [(700, None), (701, ""), (702, "..."), (None, docs[5][1]), (None, docs[6][1]), docs[7], docs[7], (5, "other W1 text"), (800, "w3 " * 30000 + "only")]
    docs += [(900 + i, "same Words here w5") for i in range(80)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(25)]
    items += [(50, None), (51, "!"), (52, "nowhere"), (53, "same words HERE"), (None, "w1 w2 only"), (3, "w9 w10"), (3, "w9"), (54, " ".join(vocabulary[:100])), (55, "w0 w0 w0")]
    return docs, items


def frames(spark):
    docs, items = tables()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, n int").repartition(6)
    return docs, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")


def key(row):
    return tuple((x is None, x) for x in row)


def test_ranked(spark):
    from folioq.llm.ranked_search import ranked

    docs, items = frames(spark)
    for k, block_terms in ((50, 10**6), (3, 40)):
        got = sorted(map(tuple, ranked(docs, items, k=k, block_terms=block_terms).collect()), key=key)
        assert got == sorted(plain(*tables(), k), key=key)
    assert ranked(docs.limit(0), items).count() == ranked(docs, items.limit(0)).count() == 0
    assert ranked(docs, items.limit(0)).columns == ranked(docs, items).columns


def test_masks_pass_over_documents():
    from folioq.llm.ranked_search import Batch, best_first

    r = np.random.default_rng(2)
    counts = np.full(2000, 4)
    codes = np.sort(np.stack([r.choice(80, 4, replace=False, p=np.arange(80, 0, -1) / 3240) for _ in range(2000)]), axis=1).ravel()
    batch = Batch(np.full(2000, 10), counts, codes, np.ones(8000, np.int64), 2000, 20000)
    weights = np.arange(80) ** 3
    own, none = np.array([1, 5, 60, 79]), np.zeros(0, np.int64)
    chosen = np.zeros(80, np.int64)
    chosen[own] = weights[own]
    ids = np.arange(2000)
    held, done = best_first(batch, ids, np.zeros(2000, bool), own, chosen, (none, none.astype(bool), none), 5)
    every = np.add.reduceat(batch.shares * chosen[codes], batch.starts[:-1])
    assert held[0].tolist() == sorted(every.tolist(), reverse=True)[:5]
    assert done < 0.5 * (every > 0).sum()
    assert batch.masks(np.arange(80)).shape == (2000, 2)
