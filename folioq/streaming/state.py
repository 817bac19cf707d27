"""Counters as streams with state for each key: uses of a page that are forgotten in time, and skips that done work resets.

They need a state store that holds more than a task's memory: keep_state_on_disk sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FORGET_AFTER_DAYS = 30
LATE = "1 hour"
USAGE = "page_id string, reads long, search_hits long, last_read_at timestamp, gone boolean"
SKIPS = "kind string, pages string, skipped long"


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Usage(StatefulProcessor):
    """Counters of a page, with a timer at the end of its last use's time to be remembered."""

    def __init__(self, days: int):
        self.gap = pd.Timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "reads long, search_hits long, last_read_at timestamp, last_use timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("ts")
        now = self.counts.get() if self.counts.exists() else None
        reads, hits, last_read, last = tuple(now) if now is not None else (0, 0, None, None)
        for kind, ts in zip(events["kind"], events["ts"], strict=True):
            if last is not None and ts >= pd.Timestamp(last) + self.gap:
                reads, hits, last_read = 0, 0, None
            if kind == "read":
                reads, last_read = reads + 1, ts if last_read is None else max(pd.Timestamp(last_read), ts)
            else:
                hits += 1
            last = ts if last is None else max(pd.Timestamp(last), ts)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = pd.Timestamp(last)
        self.handle.registerTimer(int((last + self.gap).timestamp() * 1000))
        self.counts.update((int(reads), int(hits), None if last_read is None else pd.Timestamp(last_read).to_pydatetime(), last.to_pydatetime()))
        yield self._row(key, reads, hits, last_read, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        yield self._row(key, 0, 0, None, True)

    def _row(self, key, reads, hits, last_read, gone) -> pd.DataFrame:
        return pd.DataFrame({"page_id": [key[0]], "reads": [reads], "search_hits": [hits], "last_read_at": pd.Series([last_read], dtype="datetime64[us]"), "gone": [gone]})

    def close(self) -> None:
        pass


class _Skips(StatefulProcessor):
    """Skips and deferrals of an item since it was last done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("skipped", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        for outcome in pd.concat(list(rows)).sort_values("seq")["outcome"]:
            n = 0 if outcome == "done" else n + 1
        if n:
            self.count.update((int(n),))
        else:
            self.count.clear()  # nothing to remember of an item that is done
        yield pd.DataFrame({"kind": [key[0]], "pages": [key[1]], "skipped": [n]})

    def close(self) -> None:
        pass


def remembered_usage(events: DataFrame, days: int = FORGET_AFTER_DAYS, late: str = LATE) -> DataFrame:
    """events: (page_id, kind read or hit, ts). For output mode update: a page's counters whenever it is used, and gone once it hasn't been for days.

    A use after that time starts from nothing. Events later than late are dropped. The batch form is upkeep.remembered.
    """
    used = events.where("kind in ('read', 'hit')").withWatermark("ts", late)
    return used.groupBy("page_id").transformWithStateInPandas(_Usage(days), USAGE, "Update", "EventTime")


def skip_stream(log: DataFrame) -> DataFrame:
    """log: (kind, pages, outcome, seq), in order of seq. For output mode update: the skips of each item since it was last done, 0 when it is. The batch form is upkeep.skip_counts."""
    return log.where("outcome in ('done', 'skipped', 'deferred')").groupBy("kind", "pages").transformWithStateInPandas(_Skips(), SKIPS, "Update", "None")
