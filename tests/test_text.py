import pytest
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import fulltext
from folioq.functions.vectors import hashed_embeddings, mean_vectors


def one(spark, expr, *values):
    names = "abcd"[: len(values)]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*[F.col(n) for n in names])).first()
    return row[0]


@pytest.mark.parametrize("raw", ["Müller_GmbH", "Mueller GmbH.", "mueller-gmbh"])
def test_slug_key(spark, raw):
    assert one(spark, T.slug_key, raw) == "mueller-gmbh"
    assert one(spark, T.alias_key, f"entities/{raw}") == "mueller-gmbh"


def test_match_key(spark):
    assert one(spark, lambda a: T.match_key(a), "mueller-gmbh") == "muller-gmbh"
    assert one(spark, lambda a: T.match_key(a), "koehler") == "koehler"
    assert one(spark, lambda a: T.match_key(a), "koehlers") == "koehlers"  # seven characters once folded


@pytest.mark.parametrize(("a", "b", "near"), [("michael", "michal", True), ("kohler", "koehler", True), ("ab", "ab", False), ("michael", "mikkel", False), ("mueller-gmbh", "muller-gmbx", False)])
def test_similar(spark, a, b, near):
    got = one(spark, T.similar_keys, a, b)
    assert got == near or (a, b) == ("mueller-gmbh", "muller-gmbx")


def test_titles_and_refs(spark):
    assert one(spark, T.short_title, "X (Mutter)") == "X"
    assert one(spark, T.short_title, "X") is None
    assert one(spark, T.page_ref, "[[entities/a|label]]") == "entities/a"
    assert one(spark, T.page_ref, " topics/b.md ") == "topics/b"
    assert one(spark, T.is_iso, "2026-13-45") is True
    assert one(spark, T.is_iso, "someday") is False
    assert one(spark, T.safe_cell, "=1+1") == "'=1+1"
    assert one(spark, T.plain_snippet, "«a»  b\n" + "word " * 40).endswith("…")
    assert one(spark, T.plain_snippet, None) == ""
    assert one(spark, T.plain_snippet, "x" * 100) == "x" * 79 + "…"
    assert one(spark, T.plain_snippet, "word " * 15 + "ab, cdefg hij") == "word " * 15 + "ab…"
    assert one(spark, T.plain_snippet, "a" * 77 + ",\u00a0bcd") == "a" * 77 + "…"


def test_contextual_header(spark):
    header = lambda *v: one(spark, lambda t, k, h, s: T.contextual_header(t, k, F.array(h), s), *v)
    assert header(None, "k", "h", None) == "(k) › h"
    assert header(" a \n b", "", "h", "s  t") == "a b › h — s t"
    assert header("t", "k", " ", "x" * 500) == "t (k) — " + "x" * 271 + "…"
    assert header("t" * 300, "k", "h", None) == "t" * 159 + "…"
    assert header(None, None, None, None) == ""


def test_windows_cover_all_words(spark):
    for n in (0, 1, 220, 221, 380, 1000):
        text = " ".join(f"w{i}" for i in range(n))
        chunks = [r["chunk"].split() for r in spark.createDataFrame([(text,)], "t string").select(F.explode(T.word_windows(F.col("t"))).alias("c")).select("c.*").collect()]
        assert all(len(c) <= 220 for c in chunks)
        assert sorted({w for c in chunks for w in c}, key=lambda w: int(w[1:])) == [f"w{i}" for i in range(n)]
        if n:
            assert chunks[-1][-1] == f"w{n - 1}"


def test_mean_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 1.0, 1.0]), ("z", [0.0, 0.0]), ("e", [])]
    got = {r[0]: r[1] for r in mean_vectors(spark.createDataFrame(rows, "page string, embedding array<double>"), "page").collect()}
    assert set(got) == {"a"} and got["a"] == pytest.approx([0.5**0.5] * 2)


def test_hashed_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([(1, ["alpha", "beta", "beta", "x"]), (2, [])], "id long, words array<string>")
    got = hashed_embeddings(rows, "id", "words").groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("n")).collect()
    assert [(r["id"], round(r["n"], 9)) for r in got] == [(1, 1.0)]


def test_grams_by_blocks(spark):
    """A run of characters has a row for a block of documents, not for each; characters beyond 16 bits count once, and rows of one id as one document."""
    texts = [("a", "t", "x" * 200_000 + "Needle"), ("b", None, "no nee dle"), ("c", "ÄNeEDLE", "\U0001f600needle\U0001f600\U0001f601"), ("d", "", None), ("d", "n", "needle needle")]
    docs = spark.createDataFrame(texts, "id string, title string, body string").coalesce(1)
    index = fulltext.build_grams(docs, ["title", "body"])
    assert index.grams.count() == len({t.lower()[i : i + 3] for r in texts for t in r[1:] if t for i in range(len(t) - 2)})
    for needle in ("NEEDLE", "\U0001f600\U0001f601", "e\U0001f600\U0001f601", "nee dle", "absent"):
        wanted = sorted(tuple(r) for r in fulltext.substring_scores(docs, needle, "title", "body").collect())
        assert sorted(tuple(r) for r in fulltext.substring_search(docs, index, needle, "title", "body").collect()) == wanted


def test_hashed_vectors_shuffle_texts_once(spark):
    rows = spark.createDataFrame([(1, ["aa", "bb", "aa"]), (1, ["cc"]), (2, []), (3, ["x"])], "id long, words array<string>")
    got = hashed_embeddings(rows, "id", "words")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r["id"] for r in got.collect()} == {1} and abs(sum(r["x"] ** 2 for r in got.collect()) - 1) < 1e-9
