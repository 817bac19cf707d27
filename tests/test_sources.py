import pytest
from pyspark.sql import functions as F

from folioq.sources import sinks, vault
from folioq.streaming import counters

PAGE = """---
id: entities/acme
type: entity
title: Acme
summary: Kunde A.
tags: [kunde, b2b]
sources: "[[sources/x|X]]"
keep: Yes
rating: 5
---

Body.
"""


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def vault_dir(tmp_path):
    for t in vault.PAGE_TYPES:
        (tmp_path / t).mkdir()
    write(tmp_path, "entities/acme.md", PAGE)
    write(tmp_path, "concepts/deep/bad.md", "---\nid: x\ntype: concept\ntags: scalar\n---\nb")
    write(tmp_path, "topics/none.md", "no front matter")
    write(tmp_path, "topics/skip.txt", "not a page")
    return tmp_path


def test_vault(spark, vault_dir):
    pytest.importorskip("yaml")
    page = vault.read_pages(spark, str(vault_dir)).collect()
    assert len(page) == 1
    p = page[0]
    assert (p["id"], p["title"], p["tags"], p["sources"], p["keep"], p["extra"], p["body"].strip()) == ("entities/acme", "Acme", ["kunde", "b2b"], ["sources/x"], True, '{"rating": "5"}', "Body.")
    assert vault.read_all(spark, str(vault_dir)).where("error is not null").count() == 2
    got = vault.many(vault.read_pages(spark, str(vault_dir)), ["entities/none", "entities/acme"]).collect()
    assert [(r["asked"], r["found"]) for r in got] == [("entities/none", False), ("entities/acme", True)]
    assert [tuple(r) for r in vault.tree(vault.read_pages(spark, str(vault_dir))).collect()] == [("entities", "entities/acme")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "=x", ""), ("a", 'say "hi"', "z"), ("c", None, "a")], "id string, title string, note string")
    assert [r["id"] for r in sinks.ordered_table(rows, "note").collect()] == ["c", "a", "b"]
    assert [r["id"] for r in sinks.ordered_table(rows, "note", False).collect()] == ["a", "c", "b"]
    sinks.write_csv(rows.select("title", "id").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode()
    assert text.startswith("id,title\r\n") and "b,'=x\r\n" in text and 'a,"say ""hi"""\r\n' in text
    log = spark.range(120).select(F.col("id").alias("seq"), F.lit("x").alias("line"))
    assert sinks.rotated(log, most=100).agg(F.min("seq"), F.count("*")).first() == (30, 90)
    assert sinks.rotated(log, most=200).count() == 120


def test_usage_stream(spark, tmp_path):
    events = spark.createDataFrame([("p", "read", "2024-01-01 00:00:00"), ("p", "hit", "2024-01-01 00:00:01"), ("q", "read", "2024-01-02 00:00:00"), ("p", "other", "2024-01-03 00:00:00")], "page_id string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = counters.usage(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["page_id"], r["reads"], r["search_hits"]) for r in spark.table("usage").collect()} == {("p", 1, 1), ("q", 1, 0)}


def test_burst_stream(spark, tmp_path):
    rows = [("v", "a", "2024-01-01 00:00:00"), ("v", "b", "2024-01-01 00:00:04"), ("v", "x/.git/y", "2024-01-01 00:00:05"), ("v", "c", "2024-01-01 00:00:20"), ("v", "d", "2024-01-01 03:00:00")]
    events = spark.createDataFrame(rows, "root string, path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = counters.bursts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["changes"] for r in spark.table("bursts").collect()) == [1, 2]


def test_incremental_index(spark, tmp_path):
    write_version = counters.versions_writer(f"{tmp_path}/index")
    batch = lambda *rows: spark.createDataFrame(list(rows), "id string, text string")
    write_version(batch(("a", "1"), ("b", "1")), 0)
    write_version(batch(("a", "1"), ("b", "2")), 1)
    write_version(batch(("a", "1"), ("b", "2")), 1)
    assert {(r["id"], r["text"]) for r in counters.newest(spark, f"{tmp_path}/index").collect()} == {("a", "1"), ("b", "2")}
    assert spark.read.parquet(f"{tmp_path}/index").count() == 3


def test_page_stream(spark, vault_dir, tmp_path):
    got = []
    stream = counters.page_stream(spark, str(vault_dir), 1)
    q = stream.writeStream.foreachBatch(lambda df, n: got.append(df.count())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == [1, 1, 1]
