"""A burst of changes starts checks, catalogue and index once for its batch; timers run their jobs when they are due."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_segments import write

from folioq.operators import fulltext, segments
from folioq.sources import vault
from folioq.streaming import chain, counters

pytest.importorskip("yaml")


def test_bursts_start_a_run_once(spark, tmp_path):
    root, folder, out = tmp_path / "vault", f"file://{tmp_path}/index", f"file://{tmp_path}/out"
    for t in vault.PAGE_TYPES:
        (root / t).mkdir(parents=True)
    for i in range(3):
        write(root, f"entities/p{i}", f"P {i}", f"words {i} [[entities/none]]", 1_000_000 + i)
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/cp")
    run = chain.after_burst(str(root), folder, out, lambda: "2026-10-06", lambda: 1_791_244_800)
    calls = []
    counted = lambda batch, n: calls.append(n) or run(batch, n)
    schema = "root string, path string, ts timestamp"

    def change(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = counters.bursts(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        q = stream.writeStream.outputMode("append").foreachBatch(counted).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    at = datetime(2026, 10, 6)
    change("a", ("v", "entities/p0.md", at), ("v", "entities/p1.md", at + timedelta(seconds=2)), ("v", "later", at + timedelta(hours=3)))
    first = segments.newest(spark, folder)
    assert first is not None and first.done[chain.SOURCE] in calls
    found = spark.read.parquet(f"{out}/findings")
    assert {r["id"] for r in found.where("kind = 'broken-link'").collect()} == {"entities/p0", "entities/p1", "entities/p2"}
    write(root, "entities/p1", "P 1", "other [[entities/none]]", 2_000_000)
    (root / "entities/p2.md").unlink()
    change("b", ("v", "x", at + timedelta(hours=9)))
    second = segments.newest(spark, folder)
    assert second.done[chain.SOURCE] > first.done[chain.SOURCE]
    now = spark.read.parquet(f"{out}/findings").where(F.col("batch") == second.done[chain.SOURCE])
    assert {r["id"] for r in now.where("kind = 'broken-link'").collect()} == {"entities/p1"}
    index = segments.opened(spark, folder).index
    assert {r["id"] for r in fulltext.bm25(index, {"body": 1.0}, ["words", "other"]).collect()} == {"entities/p0", "entities/p1"}
    assert {r["id"] for r in spark.read.parquet(f"{out}/catalogue").collect()} == {"entities/p0", "entities/p1"}
    one = spark.createDataFrame([("v",)], "root string")
    run(one, second.done[chain.SOURCE])  # a repeated batch
    assert segments.newest(spark, folder) == second


def test_timers(spark, tmp_path):
    start = datetime(2026, 1, 1)
    due = lambda last, now: chain.audit_due(start, last and start + timedelta(seconds=last), start + timedelta(seconds=now))
    assert not due(None, 59) and due(None, 60) and not due(60, 86_459) and due(60, 86_460)
    runs, times = [], iter(range(0, 10**9, 50))
    q = chain.timed(spark, f"{tmp_path}/check", lambda: runs.append("sync"), lambda: runs.append("audit"), lambda: start + timedelta(seconds=next(times)), "1 second")
    until = time.time() + 60
    while runs.count("sync") < 4 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert runs[:4] == ["sync", "sync", "audit", "sync"]
