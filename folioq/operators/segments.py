"""An index that batches of changed pages keep up: postings, edges and chunks in segments.

A batch writes a segment: its new and changed pages with their postings, links and chunks, and
a mark for each of its ids, gone for a deleted page. A row of an older segment counts no
more once a later segment has a mark for its page. A batch becomes visible at once, by a
manifest of one file that names the segments that count; a batch that is repeated, or
fails half-way and is tried again, leaves the same index. Pages are written first and the other
parts made from them as they are written. FAN segments of one level that
follow each other become one of the next level, so a row is rewritten once for each level, and a
query reads few segments. There is one writer at a time; readers need not wait for it.

Layout under the folder: manifests/number=N, and pages, marks, postings, edges and chunks,
each with a folder segment=N.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioq.operators import chunks, fulltext, graph
from folioq.operators.search import WEIGHTS
from folioq.sources import vault
from folioq.store import stored

FAN = 8
BUCKETS = 64
#: Files of a segment's postings up to which tasks write what they make, without a shuffle.
MOST_FILES = fulltext.MOST_BUCKETS * fulltext.SALTS
_MANIFEST = "segments array<long>, levels array<int>, done map<string, long>, fields array<string>, buckets int, number long"


@dataclass(frozen=True)
class Manifest:
    """The segments that count, in order, with their levels; the last batch of each source that is in; fields and buckets of the postings."""

    number: int
    segments: tuple[int, ...]
    levels: tuple[int, ...]
    done: dict[str, int]
    fields: tuple[str, ...]
    buckets: int


def newest(spark: SparkSession, folder: str) -> Manifest | None:
    try:
        found = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifests").orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return found and Manifest(found["number"], tuple(found["segments"]), tuple(found["levels"]), dict(found["done"]), tuple(found["fields"]), found["buckets"])


def _show(spark: SparkSession, folder: str, m: Manifest) -> None:
    """Makes m the manifest that counts: one file, there or not."""
    row = [(list(m.segments), list(m.levels), m.done, list(m.fields), m.buckets)]
    spark.createDataFrame(row, _MANIFEST.rpartition(",")[0]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/number={m.number}")


def _part(spark: SparkSession, folder: str, part: str, segments: tuple[int, ...]) -> DataFrame:
    """A part's rows in some segments, with the segment's number. The first segment has the schema of all."""
    one = spark.read.parquet(f"{folder}/{part}/segment={segments[0]}")
    schema = T.StructType([*(f for f in one.schema.fields if f.name != "bucket"), *([T.StructField("bucket", T.IntegerType())] if part == "postings" else []), T.StructField("segment", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/{part}").where(F.col("segment").isin(*segments))


def _dead(marks: DataFrame) -> DataFrame:
    """Rows (id, segment) of pages that a later segment has a mark for, or that are gone there."""
    last = marks.groupBy("id").agg(F.max("segment").alias("last"))
    return marks.join(last, "id").where((F.col("segment") < F.col("last")) | F.col("gone")).select("id", "segment")


@dataclass(frozen=True)
class Opened:
    index: fulltext.Index
    pages: DataFrame
    edges: DataFrame
    chunks: DataFrame
    manifest: Manifest


def opened(spark: SparkSession, folder: str) -> Opened:
    """The index as its newest manifest has it."""
    m = newest(spark, folder)
    if m is None:
        raise ValueError(f"{folder!r} holds no index")
    marks = _part(spark, folder, "marks", m.segments)
    dead = stored(_dead(marks), "dead")

    def live(part, key="id"):
        rows = _part(spark, folder, part, m.segments)
        rows = fulltext.unpacked(rows) if part == "postings" else rows
        return rows.join(dead.withColumnRenamed("id", key), [key, "segment"], "left_anti").drop("segment")

    pages = live("pages")
    sums = [F.coalesce(F.sum(f"len_{i}"), F.lit(0)).alias(f"n_words_{i}") for i in range(len(m.fields))]
    totals = stored(pages.agg(F.count("*").alias("n_docs"), *sums), "totals")
    index = fulltext.Index(live("postings"), totals, m.fields, m.buckets)
    return Opened(index, pages.drop(*[f"len_{i}" for i in range(len(m.fields))]), live("edges", "src"), live("chunks"), m)


def _put(rows: DataFrame, folder: str, part: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """A segment's part, written and read again."""
    path = f"{folder}/{part}/segment={number}"
    if part == "postings":
        fulltext.write_postings(rows, path, MOST_FILES // buckets)
    else:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def apply(folder: str, pages: DataFrame, gone: DataFrame | None, batch: int, source: str = "pages", fields: tuple[str, ...] = tuple(WEIGHTS), buckets: int = BUCKETS, fan: int = FAN) -> Manifest:
    """Brings a batch in. pages: (id, file_hash, title, body, summary, ...), one row for each id; gone: (id) of deleted pages.

    Pages that are indexed with the same hash are passed over. A batch of a source that is in already, or an earlier one, changes nothing.
    """
    spark = pages.sparkSession
    m = newest(spark, folder) or Manifest(-1, (), (), {}, fields, buckets)
    if m.done.get(source, -1) >= batch:
        return m
    number = m.number + 1
    new = replace(m, number=number, done=m.done | {source: batch})
    lengths = [F.size(fulltext.tokens(F.col(f))).alias(f"len_{i}") for i, f in enumerate(m.fields)]
    known = None
    if m.segments:
        pages = stored(pages, "batch")
        marks, held = _part(spark, folder, "marks", m.segments), _part(spark, folder, "pages", m.segments)
        asked = pages.select("id") if gone is None else pages.select("id").unionByName(gone.select("id"))
        asked = stored(asked.distinct(), "asked")
        known = held.select("id", "segment", "file_hash").join(asked, "id", "left_semi").join(_dead(marks.join(asked, "id", "left_semi")), ["id", "segment"], "left_anti")
        known = stored(known.select("id", F.col("file_hash").alias("old_hash")), "known")
        # Ids and hashes meet the known ones, and texts the ids that are left out, which seldom need a shuffle of texts.
        same = pages.select("id", "file_hash").join(known, "id").where(F.col("file_hash").eqNullSafe(F.col("old_hash"))).select("id")
        changed = stored(pages.select("id").join(same, "id", "left_anti"), "changed")
        pages = pages.join(changed, "id", "left_semi")
    held = _put(pages.select("*", *lengths), folder, "pages", number)
    marks = held.select("id", F.lit(False).alias("gone"))
    if gone is not None and known is not None:
        left = gone.select("id").distinct().join(known, "id", "left_semi").join(marks, "id", "left_anti")
        marks = marks.unionByName(left.select("id", F.lit(True).alias("gone")))
    marks = _put(marks, folder, "marks", number)
    if not marks.isEmpty():
        for part, rows in {"postings": fulltext.posting_rows(held, list(m.fields), "id", m.buckets), "edges": graph.raw_edges(held), "chunks": chunks.section_chunks(held)}.items():
            _put(rows, folder, part, number, m.buckets)
        new = replace(new, segments=(*m.segments, number), levels=(*m.levels, 0))
    _show(spark, folder, new)
    return compacted(spark, folder, new, fan)


def compacted(spark: SparkSession, folder: str, m: Manifest, fan: int = FAN) -> Manifest:
    """Merges the last fan segments while they are of one level."""
    while len(m.levels) >= fan and len(set(m.levels[-fan:])) == 1:
        merged, number = m.segments[-fan:], m.number + 1
        marks = _part(spark, folder, "marks", merged)
        dead = stored(_dead(marks), "dead")
        for part in ("pages", "edges", "chunks"):
            rows, key = _part(spark, folder, part, merged), "src" if part == "edges" else "id"
            _put(rows.join(dead.withColumnRenamed("id", key), [key, "segment"], "left_anti").drop("segment"), folder, part, number)
        held = _part(spark, folder, "pages", (number,)).drop("segment")
        _put(fulltext.posting_rows(held, list(m.fields), "id", m.buckets), folder, "postings", number, m.buckets)
        last = marks.groupBy("id").agg(F.max_by("gone", "segment").alias("gone"))
        _put(last if len(merged) < len(m.segments) else last.where("not gone"), folder, "marks", number)  # nothing older is left that a mark could hide
        m = replace(m, number=number, segments=(*m.segments[:-fan], number), levels=(*m.levels[:-fan], m.levels[-1] + 1))
        _show(spark, folder, m)
    return m


def writer(folder: str, source: str = "pages", fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of streaming.counters.page_stream: parses the files of a batch and brings its pages in. Of two files of one id the newer counts."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = batch.withColumn("file_hash", F.sha2("raw", 256)).withColumn("p", vault.parsed(F.col("raw"))).where("p.error is null")
        rows = parsed.select("path", "file_mtime", "file_hash", "p.*").drop("error")
        one = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("file_mtime", "path")).alias("r")).select("id", "r.*")
        apply(folder, one, None, number, source, fan=fan)

    return write


def prune(folder: str, pages: DataFrame, batch: int, source: str = "prune", fan: int = FAN) -> Manifest:
    """Takes pages out of the index that pages (id) no longer has."""
    held = opened(pages.sparkSession, folder).pages
    gone = held.select("id").join(pages.select("id"), "id", "left_anti")
    return apply(folder, held.where("false"), gone, batch, source, fan=fan)
