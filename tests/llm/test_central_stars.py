"""A large group of near copies is linked through its centre, and what is left meets once for each pair."""

import random

from test_parity_join import key, plain


def test_large_group_of_near_copies(spark, monkeypatch):
    from folioq.llm import jaccard
    from folioq.llm.parity_join import joined

    r = random.Random(3)
    base = ["w%d" % r.randint(0, 3000) for _ in range(148)]
    texts = [" ".join(base)]
    for _ in range(400):
        edited = list(base)
        for _ in range(r.randint(1, 4)):
            edited[r.randrange(len(edited))] = "x%d" % r.randint(0, 10**6)
        texts.append(" ".join(edited))
    r.shuffle(texts)
    met, counts = jaccard._met, []

    def counted(*args):
        out = met(*args)
        counts.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "_met", counted)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = sorted(plain(rows), key=key)
    found = lambda: sorted(map(tuple, joined(docs).drop("key").collect()), key=key)
    assert found() == wanted
    assert sum(n for n, _ in counts) < len(texts)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    counts.clear()
    assert found() == wanted
    assert counts[0][0] == counts[0][1] > len(texts)
    monkeypatch.setattr(jaccard, "BEFORE", 2, raising=False)
    assert found() == wanted
