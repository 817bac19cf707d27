import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioq.operators import fulltext, fusion, metrics


def hits(spark, pairs):
    return spark.createDataFrame(list(pairs), "id string, score double")


def lists(spark):
    dense = [(f"d{i:02d}", 1.0 - 0.01 * i) for i in range(40)]
    fts = [(f"d{i:02d}", 10.0 - 0.1 * (i - 20)) for i in range(20, 30)]
    return hits(spark, fts), hits(spark, dense)


def test_summary_weighs_more(spark):
    text = "pricing and delivery terms"
    rows = [("a", "t", text, ""), ("b", "t", text, "renewal"), ("c", "t", text + " renewal", "")]
    docs = spark.createDataFrame(rows, "id string, title string, body string, summary string")
    index = fulltext.build_index(docs, ["title", "body", "summary"])
    got = fulltext.bm25(index, {"title": 3.0, "body": 1.0, "summary": 5.0}, ["renewal"]).orderBy("score", ascending=False)
    assert [r["id"] for r in got.collect()] == ["b", "c"]


def test_bm25_against_plain_version(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["foo", "bar", "Été", "x_y", "z"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 4)), text(r.randint(0, 30)), None if i % 3 else text(3)) for i in range(60)] + [(60, None, None, None), (61, "", "!", "")]
    weights = {"title": 3.0, "body": 1.0, "summary": 5.0}
    index = fulltext.build_index(spark.createDataFrame(rows, "id long, title string, body string, summary string"), list(weights), buckets=3)

    def words(t):
        return re.split(r"[\W_]+", (t or "").lower().replace("é", "e"))

    for terms, used in ((["foo", "ETE"], weights), (["foo-bar", "x_y", "nothing"], weights), (["bar-foo-bar"], {"body": 1.0})):
        phrases = [[w for w in words(t) if w] for t in terms]
        fields = {f: [[w for w in words(row[1 + i]) if w] for row in rows] for i, f in enumerate(weights)}
        count = lambda ws, p: sum(ws[i : i + len(p)] == p for i in range(len(ws)))
        n = [[{f: count(fields[f][d], p) for f in used} for p in phrases] for d in range(len(rows))]
        length = [sum(len(fields[f][d]) for f in used) for d in range(len(rows))]
        mean = sum(length) / len(rows)
        wanted = {}
        for d in range(len(rows)):
            if any(any(x.values()) for x in n[d]):
                score = 0.0
                for k in range(len(phrases)):
                    df = sum(any(n[e][k].values()) for e in range(len(rows)))
                    tf = sum(w * n[d][k][f] for f, w in used.items())
                    score += max(1e-6, math.log((len(rows) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[d] / mean))
                wanted[d] = pytest.approx(score, abs=2e-6)
        assert {x["id"]: x["score"] for x in fulltext.bm25(index, used, terms).collect()} == wanted and wanted
    assert fulltext.bm25(index, weights, ["!"]).count() == 0
    none = fulltext.build_index(spark.createDataFrame([], "id long, title string"), ["title"])
    assert fulltext.bm25(none, {"title": 1.0}, ["foo"]).count() == 0


def test_query_terms():
    assert fulltext.query_terms("U.S. a.b foo-bar ??") == ["us", "ab", "foo-bar"]


def test_rrf_pushes_out_the_best_dense_hit(spark):
    fts, dense = lists(spark)
    top = [r["id"] for r in fusion.rrf(fts, dense).orderBy("score", "id", ascending=[False, True]).limit(10).collect()]
    assert "d00" not in top


def test_dense_first_keeps_the_dense_top(spark):
    fts, dense = lists(spark)
    got = fusion.dense_first(fts, dense, 10).orderBy("place").collect()
    assert got[0]["id"] == "d00" and [r["id"] for r in got[:10]] == [f"d{i:02d}" for i in range(10)]
    scores = [r["score"] for r in got]
    assert scores == sorted(scores, reverse=True)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), unique=True, max_size=12), st.lists(st.integers(0, 30), unique=True, max_size=12), st.integers(1, 6))
def test_dense_first_invariants(spark, a, b, k):
    fts, dense = hits(spark, [(f"{x:02d}", float(50 - i)) for i, x in enumerate(a)]), hits(spark, [(f"{x:02d}", float(50 - i)) for i, x in enumerate(b)])
    got = fusion.dense_first(fts, dense, k).orderBy("place").collect()
    assert {r["id"] for r in got} == {f"{x:02d}" for x in {*a, *b}}
    assert {r["id"] for r in got[: min(k, len(b))]} == {f"{x:02d}" for x in b[:k]}
    assert all(x["score"] >= y["score"] for x, y in zip(got, got[1:], strict=False))


def test_convex_of_equal_scores(spark):
    got = {r["id"]: r["score"] for r in fusion.convex(hits(spark, [("a", 2.0), ("b", 2.0)]), hits(spark, [("b", 1.0)])).collect()}
    assert got == {"a": pytest.approx(0.3), "b": pytest.approx(1.0)}


def test_metrics(spark):
    ranked = [("1", "a", 1), ("1", "b", 2), ("1", "c", 3), ("2", "x", 1), ("2", "a", 2), ("2", "y", 3), ("3", "x", 1), ("3", "y", 2), ("4", "z", 11)]
    expected = [("1", "a"), ("2", "a"), ("2", "b"), ("3", "z"), ("4", "z")]
    ranked, expected = spark.createDataFrame(ranked, "query string, id string, rank int"), spark.createDataFrame(expected, "query string, id string")
    got = {r["query"]: tuple(r)[1:] for r in metrics.query_metrics(ranked, expected).collect()}
    n2 = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert got["1"] == pytest.approx((1, 1, 1))
    assert got["2"] == pytest.approx((0.5, 0.5, n2))
    assert got["3"] == got["4"] == (0, 0, 0)
    assert tuple(metrics.mean_metrics(metrics.query_metrics(ranked.limit(0), expected.limit(0))).first()) == (0, 0, 0)


def test_snippet(spark):
    from pyspark.sql import functions as F

    text = " ".join(["x"] * 40 + ["alpha", "beta"] + ["y"] * 5)
    got = spark.createDataFrame([(text,)], "t string").select(fulltext.best_window(F.split("t", " "), ["alpha", "beta"])).first()[0]
    assert "«alpha» «beta»" in got and len(got.split()) == 24
