"""Search, lookup, similar pages, writes, reports and streams as a user calls them."""

import pytest
from pyspark.sql import functions as F
from test_pages import NOW, OLD, frame, rows

from folioq import evaluate
from folioq.functions.vectors import mean_vectors
from folioq.knowledge_base import KnowledgeBase
from folioq.operators import lint, names, refactor, search, similar, upkeep
from folioq.sources import vault, writes
from folioq.streaming import counters

VECTORS = "chunk_id long, page_id string, embedding array<double>"


@pytest.fixture(scope="module")
def base(spark):
    pages = frame(
        spark,
        {"id": "entities/kunde-a", "title": "Kunde A", "body": "Der Vertrag mit Kunde A. [[entities/kunde-b]]", "summary": "Vertrag"},
        {"id": "entities/kunde-b", "title": "Kunde B", "body": "Kunde B isst Pizza.", "distinct_from": ["topics/nlspec"]},
        {"id": "topics/nlspec", "type": "topic", "title": None, "body": "A spec in natural language"},
    ).withColumn("path", F.concat("id", F.lit(".md"))).withColumn("created", F.lit(None).cast("string"))
    chunks = spark.createDataFrame([(1, "entities/kunde-a", [1.0, 0.0]), (2, "entities/kunde-b", [0.8, 0.6]), (3, "topics/nlspec", [0.0, 1.0]), (4, "topics/nlspec", [0.0])], VECTORS)
    access = spark.createDataFrame([("entities/kunde-b", 3, 0, None)], "page_id string, reads long, search_hits long, last_read_at timestamp")
    means = mean_vectors(chunks, "page_id", order="chunk_id")
    return KnowledgeBase(pages, access, chunks, means, lambda q: F.array(F.lit(0.0), F.lit(1.0)), search.Embedders("hash", "hash"))


def test_search(base):
    got = base.search("Vertrag").collect()
    # By vectors nlspec, b, a; the text's only hit, a, gains 0.5 / 60 on its 1 / 12 and passes b's 1 / 11.
    assert [r["id"] for r in got] == ["topics/nlspec", "entities/kunde-a", "entities/kunde-b"]
    assert got[0]["title"] == "topics/nlspec" and got[0]["path"] == "topics/nlspec.md" and got[0]["snippet"] == ""
    assert got[1]["snippet"] == "der «vertrag» mit kunde a entities kunde b"  # body and summary hold the word: the earlier field
    assert base.search("  ").count() == 0
    assert base.search("Vertrag", 1).count() == 1 and search.clamped(99) == 20 and search.clamped(None) == 10
    empty = search.search(base.pages, base.index, base.chunks.where("false"), "Ver", F.array(F.lit(1.0)))
    assert [(r["id"], r["score"]) for r in empty.collect()] == [("entities/kunde-a", 1.0)]
    assert search.Embedders("a", "b").warning() and base.embedders.warning() is None


def test_modes_and_evaluation(spark, base):
    got = search.modes(search.text_candidates(base.index, "Pizza"), search.dense_candidates(base.chunks, base.embed("x")))
    assert [r["id"] for r in got.where("mode = 'fts-only'").collect()] == ["entities/kunde-b"]
    assert got.where("mode = 'dense-only'").count() == got.where("mode = 'hybrid'").count() == 3
    entries = spark.createDataFrame([("q1", "Pizza", ["entities/kunde-b", "gone"], [0.0, 1.0]), ("q2", "x", [], [1.0, 0.0])], "id string, query string, expected array<string>, vector array<double>")
    out = evaluate.evaluated(base, entries)
    assert {r["fusion"] for r in out["fusions"].collect()} == set(search.FUSIONS)
    assert [r["id"] for r in out["skipped"].collect()] == ["q2"] and rows(out["unknown"].select("id")) == [("gone",)]
    assert {r["mode"]: r["recall"] for r in out["modes"].collect()} == dict.fromkeys(search.MODES, 0.5)
    assert list(evaluate.evaluated(base, entries.where("id = 'q2'"))) == ["skipped"]


def test_evaluation_of_files(spark, tmp_path):
    """From a folder and a set file: with vectors of hashed words, and with given ones."""
    pytest.importorskip("yaml")
    for name, body in (("entities/pizza", "Pizza mit Käse"), ("topics/recht", "Vertrag und Recht"), ("topics/leer", "")):
        path = tmp_path / "vault" / f"{name}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"---\nid: {name}\ntype: topic\n---\n{body}\n")
    for t in ("concepts", "sources"):
        (tmp_path / "vault" / t).mkdir()
    entries = spark.createDataFrame([("q1", "pizza käse", ["entities/pizza"]), ("q2", "recht", ["topics/recht"])], "id string, query string, expected array<string>")
    entries.write.parquet(f"{tmp_path}/set")
    base, named = evaluate.opened(spark, str(tmp_path / "vault"), f"{tmp_path}/set")
    out = evaluate.evaluated(base, named)
    assert {r["mode"]: r["mrr"] for r in out["modes"].collect()} == dict.fromkeys(search.MODES, 1.0)
    spark.createDataFrame([("c1", "entities/pizza", [1.0, 0.0]), ("c2", "topics/recht", [0.0, 1.0])], "chunk_id string, page_id string, embedding array<double>").write.parquet(f"{tmp_path}/chunks")
    named.drop("vector").withColumn("vector", F.when(F.col("id") == "q1", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))).write.parquet(f"{tmp_path}/given")
    base, named = evaluate.opened(spark, str(tmp_path / "vault"), f"{tmp_path}/given", f"{tmp_path}/chunks")
    assert {r["mode"]: r["mrr"] for r in base.evaluate(named)["modes"].collect()}["dense-only"] == 0.5
    assert base.page_vectors.count() == 2
    assert [tuple(r) for r in base.graph(types=["topic"])[0].select("id").orderBy("id").collect()] == [("entities/pizza",), ("topics/leer",), ("topics/recht",)]
    log = spark.createDataFrame([], "kind string, pages string, outcome string, seq long")
    assert base.queue(log, 0).count() == 0


def test_similar(base):
    assert [(r["id"], r["type"]) for r in base.similar("entities/kunde-a").collect()] == [("entities/kunde-b", "entity"), ("topics/nlspec", "topic")]
    assert [r["id"] for r in base.similar("entities/kunde-b").collect()] == ["entities/kunde-a"]
    without = base.page_vectors.where("page_id <> 'entities/kunde-a'")
    assert similar.similar(without, base.chunks, base.pages, "entities/kunde-a", 1).first()["score"] == 0.8
    assert similar.similar(without, base.chunks.limit(0), base.pages, "entities/kunde-a").count() == 0


def test_first_vector_fixes_the_size(spark):
    chunks = spark.createDataFrame([(2, "p", [3.0, 4.0]), (1, "p", [2.0]), (3, "p", [6.0, 8.0]), (4, "q", [0.0, 0.0])], VECTORS)
    assert rows(mean_vectors(chunks, "page_id", order="chunk_id")) == [("p", [1.0])]


def test_lookup(base):
    assert rows(base.lookup("kunde-a").select("id", "reason")) == [("entities/kunde-a", "exact"), ("entities/kunde-b", "similar")]
    assert rows(base.lookup("topics/kunde-a")) == []
    assert base.lookup("entities/kunde-b").first()["title"] == "Kunde B"


def test_many_names_stay_linked(spark):
    pages = frame(spark, *({"id": f"entities/n{i:04d}", "aliases": ["Same"]} for i in range(names.NAME_CAP + 5)))
    got = names.collisions(pages)
    assert got.count() == names.NAME_CAP + 4 and {r["a"] for r in got.collect()} == {"entities/n0000"}


def test_tools(spark, base):
    page = base.query("type:entity", "2026-01-01", limit=1).collect()
    assert len(page) == 1 and page[0]["total"] == 2 and page[0]["next_offset"] == 1
    assert base.query("type:entity", "2026-01-01", offset=1).first()["next_offset"] is None
    got = base.read(["entities/kunde-b", "none", "entities/kunde-b"], links=True).collect()
    assert [(r["found"], r["backlinks"]) for r in got] == [(True, ["entities/kunde-a"]), (False, []), (True, ["entities/kunde-a"])]
    assert vault.page(base.pages, "topics/nlspec").first()["title"] == "topics/nlspec"
    assert base.backlinks("entities/kunde-b").count() == 1 and base.tree().count() == 3 and base.tags(None, "2026-01-01").count() == 0
    assert "new text" in base.patch("topics/nlspec", "## H", "new text").where("id = 'topics/nlspec'").first()["body"]
    assert rows(base.status()) == [(3, 4)] and base.catalogue().count() == 3
    assert base.rename("entities/kunde-b", "entities/kunde-c").where("id = 'entities/kunde-c'").count() == 1
    assert base.delete("entities/kunde-b", force=True).count() == base.merge("entities/kunde-b", "entities/kunde-a").count() == 2
    events = upkeep.counter_events(base.search("Vertrag"), spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), F.current_timestamp())
    assert rows(events.groupBy("kind").count()) == [("hit", 3), ("read", 2)]


def test_writes(spark, base, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    new = base.pages.where("id = 'entities/kunde-b'").withColumns({"id": F.lit("entities/New.1"), "body": F.lit("[[entities/none]]")})
    after, found = base.write(new, "2026-10-06", NOW)
    assert after.count() == 4 and {r["kind"] for r in found.collect()} >= {"broken-link"} and {r["id"] for r in found.collect()} == {"entities/New.1"}
    for wrong in (new.withColumn("id", F.lit("entities/a b")), new.withColumn("type", F.lit("odd")), new.withColumn("title", F.lit(" ")), new.unionByName(new)):
        with pytest.raises(ValueError):
            base.write(wrong, "2026-10-06", NOW)
    assert writes.raw_path("01_raw/a/b.pdf") == writes.raw_path("a/b.pdf") == "01_raw/a/b.pdf"
    for wrong in ("", "../x", "/x", "a//b", "C:/x", "a/"):
        with pytest.raises(ValueError):
            writes.raw_path(wrong)
    files = spark.createDataFrame([("m/1.eml", b"x")], "path string, content binary")
    assert rows(writes.write_raw(files, f"file://{tmp_path}", "batch-1")) == [("01_raw/m/1.eml",)]
    assert spark.read.parquet(f"file://{tmp_path}/01_raw/batch-1").count() == 1
    with pytest.raises(ValueError):
        writes.write_raw(files.withColumn("path", F.lit("../x")), f"file://{tmp_path}", "b")
    target = f"file://{tmp_path}/catalogue"
    assert writes.write_if_changed(base.catalogue(), target) and not writes.write_if_changed(base.catalogue(), target)
    assert writes.write_if_changed(base.catalogue().limit(1), target)


def test_ids(spark):
    ids = {"entities/A.b": (1, 1), "topics/x/y": (1, 1), "concepts/ü": (1, 0), "sources/a.md": (1, 0), "entities/a.": (1, 0), "entities/-a": (1, 0), "odd/a": (0, 0), "entities": (0, 0), "entities/": (0, 0), "entities//a": (0, 0), "entities/./a": (0, 0), "entities/a..b": (0, 0), "/entities/a": (0, 0), "entities/a:b": (0, 0), "entities/a\\b": (0, 0), "entities/a\tb": (0, 0), None: (0, 0)}
    got = spark.createDataFrame([(x,) for x in ids], "id string").select("id", refactor.valid_id(F.col("id")).alias("v"), refactor.valid_new_id(F.col("id")).alias("n")).collect()
    assert {r["id"]: (int(r["v"]), int(r["n"])) for r in got} == ids


def test_report_holds_every_kind(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pages = frame(spark, {"id": "entities/a", "title": "Same", "aliases": ["B"]}, {"id": "entities/b", "title": "same"}, *({"id": f"topics/t{i}", "type": "topic", "title": "many"} for i in range(11)))
    files = spark.createDataFrame([("topics/bad.md", "no front matter"), ("topics/t0.md", None)], "path string, error string")
    vectors = spark.createDataFrame([("entities/a", "entity", [1.0, 0.0]), ("entities/b", "entity", [1.0, 0.0])], "id string, type string, embedding array<double>")
    found = lint.report(pages, "2026-10-06", NOW, files, vectors, "model", "model")
    said = {(r["kind"], r["id"]): r["detail"] for r in found.collect()}
    assert said["frontmatter", "topics/bad.md"] == "no front matter"
    assert said["alias-collision", "entities/b"] == "entities/a" and said["duplicate-candidate", "entities/b"] == "entities/a (same title, similarity 1.00)"
    assert said["duplicate-detection-skipped", ""] == "11 pages of type topic share the title many"
    assert "hygiene-skipped" in {r["kind"] for r in lint.report(pages, "2026-10-06", NOW, None, vectors, "hash", "model").collect()}
    assert {r["kind"] for r in lint.shown(found, True, "orphan").collect()} == {"orphan"}
    assert {r["kind"]: r["n"] for r in lint.shown(found).collect()}["alias-collision"] == 2
    assert "alias-collision" not in {r["kind"] for r in lint.loud(found).collect()}


def test_unchanged_and_counters(spark):
    pages = spark.createDataFrame([(x, "h", "s") for x in "abcde"], "id string, file_hash string, summary string")
    index = spark.createDataFrame([("a", "h", "h", "s"), ("b", "h", None, "s"), ("c", "h", "h", "t"), ("d", "h", "h", "s")], "id string, file_hash string, summary_indexed_hash string, summary string")
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "page_id string")
    assert [r["id"] for r in upkeep.unchanged(pages, index, chunks).where("unchanged").collect()] == ["a"]
    access = spark.createDataFrame([("here", 1, None), ("old", 1, OLD), ("new", 1, NOW), ("never", 0, None)], "page_id string, reads long, t long").select("page_id", "reads", F.timestamp_seconds("t").alias("last_read_at"))
    assert {r["page_id"] for r in upkeep.without_gone(access, spark.createDataFrame([("here",)], "id string"), NOW).collect()} == {"here", "new"}


def test_cached_queue(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(len(made))

    folder = f"file://{tmp_path}/queue"
    for now, count in (("2026-01-01T10:00:00+00:00", 1), ("2026-01-01T10:59:00+00:00", 1), ("2026-01-01T11:00:00+00:00", 2)):
        assert upkeep.cached_queue(spark, folder, now, build).count() == count
    assert len(made) == 2


def test_watched_paths_and_recent_usage(spark, tmp_path):
    paths = {"w/entities/a.md": True, "w/.git/index": False, "w/00_meta/log.md": False, "w/00_meta/AGENTS.md": True, "00_meta/audit/x.md": False}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", counters.relevant_path(F.col("path")).alias("r")).collect()
    assert {r["path"]: r["r"] for r in got} == paths
    events = spark.createDataFrame([("a", "read", 0), ("a", "hit", 86400), ("b", "read", 90 * 86400)], "page_id string, kind string, t long").select("page_id", "kind", F.timestamp_seconds("t").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = counters.every(counters.recent_usage(stream), lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}"), "1 second", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").select("page_id").distinct().count() >= 1
