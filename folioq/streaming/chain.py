"""What follows a burst of changes, and what runs by the clock.

A closed burst (counters.bursts) starts one run: the changed pages are checked, the catalogue is
written if it differs, and the index takes the changes in, last, with the number of the
batch. A batch that is repeated is known by that number and does nothing; one that failed
half-way is done again in whole, over its own files.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import lint, segments
from folioq.sources import sinks, vault, writes
from folioq.store import stored
from folioq.streaming.counters import AUDIT_EVERY, FIRST_AUDIT, SYNC_EVERY

SOURCE = "bursts"


def changed_ids(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Ids (id) of pages that are new or changed against the index, and of those that are gone."""
    spark = pages.sparkSession
    if segments.newest(spark, folder) is None:
        return pages.select("id"), pages.select("id").where("false")
    held = segments.opened(spark, folder).pages.select("id", F.col("file_hash").alias("old"))
    both = stored(pages.select("id", "file_hash").join(held, "id", "full"), "changes")
    return both.where("file_hash is not null and not file_hash <=> old").select("id"), both.where("file_hash is null").select("id")


def after_burst(root: str, folder: str, out: str, today: Callable[[], str], now: Callable[[], int], fan: int = segments.FAN) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of counters.bursts: findings of the changed pages to out/findings/batch=N, the catalogue to out/catalogue, changes to the index in folder."""

    def run(closed: DataFrame, number: int) -> None:
        spark = closed.sparkSession
        known = segments.newest(spark, folder)
        if closed.isEmpty() or known is not None and known.done.get(SOURCE, -1) >= number:
            return
        pages = stored(vault.read_pages(spark, root), "pages")
        changed, gone = changed_ids(pages, folder)
        findings = lint.of_paths(lint.report(pages, today(), now()), changed)
        findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        writes.write_if_changed(sinks.catalogue(pages.withColumn("updated_at", F.col("updated"))), f"{out}/catalogue")
        segments.apply(folder, pages.join(changed, "id", "left_semi"), gone, number, SOURCE, fan=fan)

    return run


def _seconds(interval: str) -> timedelta:
    n, unit = interval.split()
    return timedelta(**{unit: int(n)})


def audit_due(started: datetime, last: datetime | None, now: datetime) -> bool:
    """The first audit comes FIRST_AUDIT after the start, each other AUDIT_EVERY after the last."""
    return now - started >= _seconds(FIRST_AUDIT) if last is None else now - last >= _seconds(AUDIT_EVERY)


def timed(spark: SparkSession, checkpoint: str, sync: Callable[[], None], audit: Callable[[], None], clock: Callable[[], datetime] = datetime.now, every: str = SYNC_EVERY):
    """Starts a query that runs sync every time its interval is over, and audit whenever it is due."""
    started, last = clock(), []

    def tick(batch: DataFrame, number: int) -> None:
        sync()
        if audit_due(started, last[-1] if last else None, clock()):
            audit()
            last.append(clock())

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def audit(root: str, out: str, today: Callable[[], str], now: Callable[[], int], spark: SparkSession) -> None:
    """A full check of the vault, grouped, to out/audit/day=TODAY."""
    report = lint.report(vault.read_pages(spark, root), today(), now())
    sinks.audit_groups(report).write.mode("overwrite").parquet(f"{out}/audit/day={today()}")


__all__ = ["after_burst", "audit", "audit_due", "changed_ids", "timed"]
