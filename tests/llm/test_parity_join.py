"""The similarity join against all pairs, and the bounds that it rests on."""

import random

import brute
import numpy as np


def shingles(text):
    w = brute.words(brute.lower(text))
    return frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(docs, percent=90):
    """docs: (id, text). Rows (id, size, component)."""
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def corpus():
    r = random.Random(11)
    word = lambda: "w%d" % r.randint(0, 3000)
    texts = []
    for group in range(60):
        base = [word() for _ in range(r.choice([3, 8, 12, 20, 21, 22, 60, 200, 900]))]
        for _ in range(60 if group == 0 else 5):
            edited = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 40)):
                edited[r.randrange(len(edited))] = word()
            texts.append(r.choice([" ", "\t"]).join(edited).upper())
    texts += ["", None, "  ", None, "short text", "Short  text", "short texts", "one", "ONE", "Ä b c", "ä b c"]
    rows = list(enumerate(texts))
    return rows + [(None, texts[7]), (None, "alone for itself"), (None, None), rows[9], rows[9], (9, "same id other text")]


def key(row):
    return tuple((x is None, x) for x in row)


def test_join(spark, monkeypatch):
    from folioq.llm import jaccard
    from folioq.llm.parity_join import joined

    rows = corpus()
    docs = spark.createDataFrame([(*x, "c", "r", 1) for x in rows], "doc_id long, text string, class string, root string, size long").repartition(5)
    found = lambda **options: sorted(map(tuple, joined(docs, **options).drop("key").collect()), key=key)
    wanted = sorted(plain(rows), key=key)
    assert 60 < len({w[2] for w in wanted}) < len(rows) - 60
    assert found() == wanted
    monkeypatch.setattr(jaccard, "ROUNDS", 0)  # all by pairs, in pieces
    monkeypatch.setattr(jaccard, "PIECE", 4)
    assert found() == wanted
    assert joined(docs.limit(0)).count() == 0


def words_of(signature):
    number, own, *words = signature
    return {(number, i, w) for i, w in enumerate(words[:own])} | {(number + 1, i, w) for i, w in enumerate(words[own:])}


def test_similar_sets_agree_in_a_word():
    from folioq.llm.parity_join import band, most_apart, signatures, sketch

    r = np.random.default_rng(0)
    for _ in range(400):
        n = int(r.integers(1, 900))
        x = r.integers(0, 1 << 64, n, np.uint64)
        gone, new = int(r.integers(0, n // 15 + 1)), int(r.integers(0, n // 15 + 1))
        y = np.concatenate((x[gone:], r.integers(0, 1 << 64, new, np.uint64)))
        if not len(y):
            continue
        apart = gone + new
        words = int(r.integers(1, 20))
        assert int(np.bitwise_count(sketch(x, words) ^ sketch(y, words)).sum()) <= apart
        if 100 * (n - gone) >= 90 * (n + new):
            assert words_of(signatures(x, 90)) & words_of(signatures(y, 90))
    for percent in (80, 90):
        for n in range(1, 3000):
            number, low, high = band(n, percent)
            assert low <= n <= high
            assert band(100 * n // percent, percent)[0] - number <= 1
            b = 100 * n // percent
            assert (100 - percent) * (n + b) // (100 + percent) <= most_apart(band(b, percent)[2], percent)
