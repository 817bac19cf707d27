"""Streams: usage counters, bursts of changes, incremental indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators.upkeep import changed

IDLE = "5 seconds"
LATE = "1 hour"


#: The folder of the vault's own files, and those of them that users edit.
META, EDITED = "00_meta", ("AGENTS.md", "CLAUDE.md", "SKILL.md", "eval-queries.yaml")
SYNC_EVERY, FIRST_AUDIT, AUDIT_EVERY = "120 seconds", "60 seconds", "24 hours"
FORGET_AFTER = "30 days"


def relevant_path(path: Column) -> Column:
    """Whether a change of this path counts: nothing of .git, and of the vault's own files only those that users edit."""
    meta = path.rlike(rf"(^|/){META}/")
    return ~path.rlike(r"(^|/)\.git(/|$)") & (~meta | F.regexp_extract(path, r"([^/]*)$", 1).isin(*EDITED))


def every(stream: DataFrame, run: Callable[[DataFrame, int], None], interval: str, checkpoint: str):
    """Starts run on each batch, one batch an interval (SYNC_EVERY, AUDIT_EVERY)."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def recent_usage(events: DataFrame, forget: str = FORGET_AFTER) -> DataFrame:
    """usage by page and day, with state that is dropped once a day is older than forget; sums of days are a page's counters."""
    read = F.col("kind") == "read"
    days = events.where(F.col("kind").isin("read", "hit")).withWatermark("ts", forget).groupBy("page_id", F.window("ts", "1 day").alias("w"))
    counted = days.agg(F.sum(read.cast("long")).alias("reads"), F.sum((~read).cast("long")).alias("search_hits"), F.max(F.when(read, F.col("ts"))).alias("last_read_at"))
    return counted.select("page_id", F.col("w.start").alias("day"), "reads", "search_hits", "last_read_at")


def usage(events: DataFrame) -> DataFrame:
    """Running counters of each page: (page_id, reads, search_hits, last_read_at), for output mode update or complete."""
    read = F.col("kind") == "read"
    return events.where(F.col("kind").isin("read", "hit")).groupBy("page_id").agg(F.sum(read.cast("long")).alias("reads"), F.sum((~read).cast("long")).alias("search_hits"), F.max(F.when(read, F.col("ts"))).alias("last_read_at"))


def bursts(changes: DataFrame, gap: str = IDLE, late: str = LATE) -> DataFrame:
    """changes: (root, path, ts). One row when a root has been idle for gap; events later than late are dropped."""
    relevant = changes.where(relevant_path(F.col("path")))
    return relevant.withWatermark("ts", late).groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"), F.approx_count_distinct("path").alias("paths")).select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes", "paths")


def page_stream(spark: SparkSession, root: str, files_a_batch: int = 50) -> DataFrame:
    """New and changed page files as a stream (path, raw); a checkpoint makes it resume where it stopped."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(root)
    return found.select("path", F.unix_timestamp("modificationTime").alias("file_mtime"), F.col("content").alias("raw"))


def versions_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's new or changed pages (id, text) as a version of the index under folder.

    A repeated batch overwrites its own version. The newest version of a page counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = batch.select("id", "text")
        try:
            index = newest(spark, folder, number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            index = spark.createDataFrame([], "id string, file_hash string")
        state = changed(pages, index.join(pages.select("id"), "id", "left_semi"))
        new = pages.join(state.where("state in ('new', 'changed')").select("id", "file_hash"), "id")
        new.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return write


def newest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    every = spark.read.parquet(folder)
    every = every if before is None else every.where(F.col("version") < before)
    return every.groupBy("id").agg(F.max_by(F.struct("file_hash", "text"), "version").alias("last")).select("id", "last.*")
