"""Streams with state against their batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioq.operators import upkeep
from folioq.streaming import state

pytest.importorskip("google.protobuf")
DAY0 = datetime(2024, 1, 1)


def run(spark, stream, tmp_path, keys):
    """The last row of each key, and all rows, of a stream in update mode."""
    state.keep_state_on_disk(spark)
    rows = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, r.asDict()) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return {tuple(r[k] for k in keys): r for _, r in rows}, rows


def written(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_usage_is_forgotten(spark, tmp_path):
    at = lambda days: DAY0 + timedelta(days=days)
    batches = [
        [("a", "read", at(0)), ("a", "hit", at(1)), ("b", "read", at(0)), ("f", "read", at(0)), ("a", "other", at(0))],
        [("a", "read", at(20)), ("c", "hit", at(20))],
        [("d", "read", at(45)), ("a", "hit", at(45.5)), ("late", "read", at(0.5))],
        [("b", "hit", at(60)), ("c", "read", at(60)), ("e", "read", at(60))],
    ]
    schema = "page_id string, kind string, ts timestamp"
    last, rows = run(spark, state.remembered_usage(written(spark, tmp_path, batches, schema)), tmp_path, ["page_id"])
    assert {r["page_id"] for _, r in rows if r["gone"]} == {"f"}
    events = spark.createDataFrame([r for b in batches for r in b if r[0] != "late"], schema)
    batch = {r["page_id"]: r for r in upkeep.remembered(events, F.lit(at(60) - timedelta(hours=1))).collect()}
    kept = {k[0]: r for k, r in last.items() if not r["gone"]}
    assert set(kept) == set(batch) == {"a", "b", "c", "d", "e"}
    counts = lambda rows: {p: (r["reads"], r["search_hits"], r["last_read_at"]) for p, r in rows.items()}
    assert counts(kept) == counts(batch)
    assert (batch["a"]["reads"], batch["a"]["search_hits"], batch["b"]["reads"], batch["b"]["search_hits"]) == (2, 2, 0, 1)


def test_skips_are_reset(spark, tmp_path):
    batches = [
        [("orphan", "x", "skipped", 0), ("orphan", "x", "deferred", 1), ("decay", "y", "deferred", 2)],
        [("orphan", "x", "done", 3), ("decay", "y", "skipped", 4), ("merge", "a", "done", 5)],
        [("orphan", "x", "skipped", 6), ("decay", "y", "maybe", 7)],
    ]
    schema = "kind string, pages string, outcome string, seq long"
    last, _ = run(spark, state.skip_stream(written(spark, tmp_path, batches, schema)), tmp_path, ["kind", "pages"])
    log = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {(*k, r["skipped"]) for k, r in last.items() if r["skipped"]} == {tuple(r) for r in upkeep.skip_counts(log).collect()} == {("orphan", "x", 1), ("decay", "y", 2)}
