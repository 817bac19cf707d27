import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioq.operators import chunks, fulltext, refactor, versions


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "a string").select(expr(F.col("a"))).first()[0]


def test_markers(spark):
    assert one(spark, lambda a: fulltext.limited_markers(a, 2), "«alpha» «beta» «gamma» «delta» «Alpha»") == "«alpha» «beta» gamma delta Alpha"
    assert one(spark, fulltext.limited_markers, "a «open") == "a open"


def test_concise(spark):
    rows = spark.createDataFrame([(f"entities/{i}", 0.123456) for i in range(5)], "id string, score double")
    assert fulltext.concise(rows).first()["score"] == 0.1235
    assert "score" not in fulltext.concise(rows, 20).columns


def test_sections(spark):
    body = "intro words\n# A\na1\n## B ##\n```\n# not a heading\n```\nb1\n# C\n"
    assert chunks.sections(body) == [([], ["intro", "words"]), (["A"], ["a1"]), (["A", "B"], ["```", "#", "not", "a", "heading", "```", "b1"])]
    assert chunks.sections("# Only\n## Heads") == [([], ["Only", "Heads"])]
    pages = spark.createDataFrame([("p", body, "T", "entity", "S"), ("q", None, None, "topic", None)], "id string, body string, title string, type string, summary string")
    got = chunks.section_chunks(pages)
    assert [(r["chunk_idx"], r["heading_path"]) for r in got.orderBy("chunk_idx").collect()] == [(0, []), (1, ["A"]), (2, ["A", "B"])]
    texts = [r["text"] for r in chunks.embedding_texts(got, pages).orderBy("chunk_idx").collect()]
    assert texts[1] == "T (entity) › A — S\n\na1"
    out = chunks.embedded(got.select("id", F.col("chunk").alias("text")), lambda: lambda xs: [[float(len(x))] for x in xs])
    assert {len(r["text"]) == r["embedding"][0] for r in out.collect()} == {True}


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 1200))
def test_windows(n):
    words = [str(i) for i in range(n)]
    got = [w.split() for w in chunks.windows(words)]
    assert {w for c in got for w in c} == set(words)
    assert all(len(c) <= 220 for c in got) and (not n or got[-1][-1] == words[-1])


def test_wiki_links(spark):
    text = "[A](entities/a.md#x) ![i](entities/i) `[c](topics/c)` [out](https://x.org)\n| [t](entities/t) |\n```\n[f](entities/f)\n```\n[B](concepts/b)"
    wanted = "[[entities/a#x|A]] ![i](entities/i) `[c](topics/c)` [out](https://x.org)\n| [t](entities/t) |\n```\n[f](entities/f)\n```\n[[concepts/b|B]]"
    assert one(spark, refactor.wiki_links, text) == wanted
    assert one(spark, refactor.wiki_links, wanted) == wanted
    assert one(spark, refactor.excerpt, "# T\n---\n\nSee [[entities/a|the A]] and [b](topics/b).") == "See the A and b."


def test_versions(spark):
    v = spark.createDataFrame([("p", "s1", 1, "one"), ("p", "s2", 2, "two"), ("q", "s3", 3, "q")], "path string, sha string, ts long, text string")
    back = versions.restored(v, "p", "s1", "s4", 9)
    assert versions.as_of(back, 9).where("path = 'p'").first()["text"] == "one" and back.count() == 4
    assert versions.as_of(v, 2).count() == 1
    tree = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    got = versions.merged_trees(tree(("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")), tree(("a", "2"), ("b", "1"), ("c", "2"), ("n", "1")), tree(("a", "1"), ("b", "3"), ("c", "3"), ("d", "1")))
    assert sorted(map(tuple, got.collect())) == [("a", "2", "ours"), ("b", "3", "theirs"), ("c", None, "conflict"), ("n", "1", "ours")]


def test_summary_hashes(spark):
    pages = spark.createDataFrame([("a", "s", "h2"), ("b", "new", "h2"), ("c", None, "h1")], "id string, summary string, body_hash string")
    index = spark.createDataFrame([("a", "s", "h1"), ("b", "s", "h1")], "id string, summary string, summary_body_hash string")
    assert sorted((r["id"], r["summary_body_hash"]) for r in versions.summary_hashes(pages, index).collect()) == [("a", "h1"), ("b", "h2"), ("c", None)]


def test_eval_set(spark):
    none = spark.createDataFrame([], "id string, query string, expected array<string>, note string")
    first = versions.with_entry(none, "Was ist  NIS2?", ["topics/nis2"])
    assert first.first()["id"] == "q-was-ist-nis2"
    assert versions.with_entry(first, " was IST nis2? ", ["x"]).count() == 1
    assert {r["id"] for r in versions.with_entry(first, "was ist nis2!", ["x"]).collect()} == {"q-was-ist-nis2", "q-was-ist-nis2-2"}
    pages = none.sparkSession.createDataFrame([("topics/nis2",)], "id string")
    for query, expected, given in (("  ", ["topics/nis2"], {}), ("q", [], {}), ("q", ["topics/none"], {"pages": pages}), ("q", ["odd id"], {"pages": pages}), ("was ist NIS2?", ["topics/nis2"], {"pages": pages}), ("q", ["topics/nis2"], {"entry_id": "q-was-ist-nis2"})):
        with pytest.raises(ValueError):
            versions.with_entry(first, query, expected, **given)
    assert versions.with_entry(first, "q", ["topics/nis2"], pages=pages, entry_id="mine").where("id = 'mine'").count() == 1


def test_log_items(spark):
    lines = [(1, "## session"), (2, "- done merge `b`, `a` — note — more"), (3, "- skipped orphan `x`"), (4, "- odd thing")]
    got = versions.log_items(spark.createDataFrame(lines, "seq long, line string")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("merge", "a,b", "done", "note — more", 2), ("orphan", "x", "skipped", None, 3)]
