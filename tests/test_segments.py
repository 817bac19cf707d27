"""An index kept up by a stream of page files, against one built of all pages."""

import os

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from folioq.operators import fulltext, graph, search, segments
from folioq.sources import vault
from folioq.streaming import counters

pytest.importorskip("yaml")


def write(root, name, title, body, mtime):
    import os

    path = root / f"{name}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"---\nid: {name}\ntype: entity\ntitle: {title}\nsummary: of {title}\n---\n{body}\n")
    os.utime(path, (mtime, mtime))


def run(spark, root, folder, checkpoint, fan=2):
    stream = counters.page_stream(spark, str(root), 3)
    q = stream.writeStream.foreachBatch(segments.writer(folder, fan=fan)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def hits(spark, pages, index):
    chunks = spark.createDataFrame([], "chunk_id long, page_id string, embedding array<double>")
    vector = F.array(F.lit(1.0))
    return [tuple(r) for q in ("delivery terms renewal",) for r in search.search(pages, index, chunks, q, vector).collect()]


def same(spark, root, folder):
    """The kept-up index gives what one of all pages gives."""
    now = segments.opened(spark, folder)
    pages = vault.read_pages(spark, str(root))
    assert {r["id"] for r in now.pages.select("id").collect()} == {r["id"] for r in pages.select("id").collect()}
    assert hits(spark, now.pages, now.index) == hits(spark, pages, fulltext.build_index(pages, list(search.WEIGHTS)))
    edges = lambda df: sorted(map(tuple, df.select("src", "raw", "dst").collect()))
    assert edges(now.edges) == edges(graph.raw_edges(pages))
    assert now.chunks.select("id").distinct().count() == pages.count()
    return now


def test_stream_of_changes(spark, tmp_path):
    root, folder, checkpoint = tmp_path / "vault", f"file://{tmp_path}/index", str(tmp_path / "check")
    for t in vault.PAGE_TYPES:
        (root / t).mkdir(parents=True)
    for i in range(7):
        write(root, f"entities/p{i}", f"Page {i}", f"delivery terms {'renewal ' * i} [[entities/p{i + 1}]] nine", 1_000_000 + i)
    run(spark, root, folder, checkpoint)
    first = same(spark, root, folder)
    assert len(first.manifest.segments) < 3  # three batches, merged by two
    write(root, "entities/p1", "Page 1", "renewal only", 2_000_000)
    write(root, "topics/new", "New", "delivery of renewal", 2_000_001)
    run(spark, root, folder, checkpoint)
    same(spark, root, folder)
    (root / "entities/p2.md").unlink()
    (root / "entities/p6.md").unlink()
    segments.prune(folder, vault.read_pages(spark, str(root)), 0, fan=2)
    now = same(spark, root, folder)
    before = now.manifest
    pages = vault.read_pages(spark, str(root))
    assert segments.apply(folder, pages.where("false"), pages.select("id"), 0, "prune") == before  # a repeated batch
    again = segments.apply(folder, pages, None, 99, "by hand")
    assert again.segments == before.segments  # nothing has changed
    write(root, "entities/p2", "Page 2", "back with renewal", 3_000_000)
    run(spark, root, folder, checkpoint)
    same(spark, root, folder)


def test_a_batch_that_fails_half_way(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    page = lambda *rows: spark.createDataFrame(list(rows), "id string, file_hash string, title string, body string, summary string")
    segments.apply(folder, page(("a", "1", "x", "old words", None), ("b", "1", "y", "words", None)), None, 0)
    real = segments._show
    monkeypatch.setattr(segments, "_show", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        segments.apply(folder, page(("a", "2", "x", "new", None)), page().select("id"), 1)
    monkeypatch.setattr(segments, "_show", real)
    found = lambda: {r["id"] for r in fulltext.bm25(segments.opened(spark, folder).index, {"body": 1.0}, ["words"]).collect()}
    assert found() == {"a", "b"}
    segments.apply(folder, page(("a", "2", "x", "new", None)), None, 1)
    assert found() == {"b"}
    segments.apply(folder, page(), page(("b", "", "", "", "")).select("id"), 2)
    assert found() == set()
    with pytest.raises(ValueError):
        segments.opened(spark, f"file://{tmp_path}/none")


def test_postings_by_blocks(spark, monkeypatch):
    """A word has a row for a block of documents, and its places are those of the texts whatever the blocks."""
    texts = [(i, "a b a" if i % 2 else None, f"b w{i} b " * (i + 1)) for i in range(30)]
    docs = spark.createDataFrame(texts, "id long, title string, body string").coalesce(1)
    packed = fulltext.posting_rows(docs, ["title", "body"], "id", 4)
    assert packed.count() == 32
    got = sorted((r["term"], r["id"], r["field"], r["place"], r["len_0"], r["len_1"]) for r in fulltext.unpacked(packed).collect())
    words = [((t or "").split(), b.split()) for _, t, b in texts]
    assert got == sorted((w, i, f, at, len(fields[0]), len(fields[1])) for i, fields in enumerate(words) for f, ws in enumerate(fields) for at, w in enumerate(ws))
    index = fulltext.build_index(docs, ["title", "body"])
    assert tuple(index.totals.first()) == (30, sum(len(t) for t, _ in words), sum(len(b) for _, b in words))
    batch = pa.RecordBatch.from_pylist([{"id": i, "t": t, "b": b} for i, (t, b) in enumerate(words)], pa.schema([("id", pa.int64()), ("t", pa.list_(pa.string())), ("b", pa.list_(pa.string()))]))
    monkeypatch.setattr(fulltext, "BLOCK", 40)
    small = [(r["term"], i, f, at) for part in fulltext._packed([batch]) for r in part.to_pylist() for i, f, places in zip(r["id"], r["field"], r["places"], strict=True) for at in places]
    assert sorted(small) == [x[:4] for x in got]


def test_postings_are_not_shuffled(spark, tmp_path):
    """A first batch's texts are stored once, its postings are written by the tasks that make them, and a task that makes too many files has them dealt."""
    from folioq.store import shared_folder

    pages = spark.range(0, 4000, 1, 6).select("id", F.lit("h").alias("file_hash"), F.concat(F.lit("t"), "id").alias("title"), F.concat_ws(" ", F.lit("all share these words"), F.sha2(F.col("id").cast("string"), 256)).alias("body"), F.lit("").alias("summary"))
    folder, found = f"file://{tmp_path}/index", []
    batches = lambda: {p for p in os.listdir(shared_folder(spark).removeprefix("file://")) if p.startswith("batch-")}
    before, dealt = batches(), type(pages).repartition

    def repartition(self, *a):
        found.append(a)
        return dealt(self, *a)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(pages), "repartition", repartition)
        segments.apply(folder, pages, None, 0)
        assert not found and batches() == before
        patch.setattr(segments, "MOST_FILES", 0)
        segments.apply(folder, pages.withColumns({"id": F.col("id") + 2000, "file_hash": F.lit("new")}), None, 1)
        assert found
    now = segments.opened(spark, folder)
    assert sorted(r["id"] for r in now.pages.select("id").collect()) == list(range(6000))
    assert now.index.postings.where("term = 'share'").count() == 6000
