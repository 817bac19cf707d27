"""Differences of file versions by lines: shortest edit scripts, renames by shared lines, patches."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATCH_BYTES = 64 << 10
CONTEXT = 3
#: A gone and a new file are one, renamed, from this share of common lines on.
RENAMED_FROM = 0.5
#: The most edits of a middle part that are traced; a longer script gives the part up as replaced.
MOST_EDITS = 2000
CHANGES = "path string, old_path string, status string, added long, removed long, patch string, cut boolean"


def script(old: list[str], new: list[str], most: int = MOST_EDITS) -> list[tuple[str, int, int]]:
    """A shortest edit script as (kind, line of old, line of new): ' ' kept, '-' removed, '+' added. Equal ends are set aside; furthest-reaching paths give the rest."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[len(old) - 1 - tail] == new[len(new) - 1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    out = [(" ", i, i) for i in range(head)]
    reach, trace = {1: 0}, []
    for d in range(min(len(a) + len(b), most) + 1):
        trace.append(dict(reach))
        done = False
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and x - k >= 0 and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                done = True
                break
        if done:
            break
    else:
        middle = [("-", head + i, head) for i in range(len(a))] + [("+", head + len(a), head + j) for j in range(len(b))]
        return out + middle + [(" ", len(old) - tail + i, len(new) - tail + i) for i in range(tail)]
    x, y, back = len(a), len(b), []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        before = k + 1 if k == -d or k != d and reach[k - 1] < reach[k + 1] else k - 1
        px = reach[before]
        py = px - before
        while x > px and y > py and x > 0 and y > 0:
            x, y = x - 1, y - 1
            back.append((" ", head + x, head + y))
        if d:
            back.append(("+", head + x, head + y - 1) if x == px else ("-", head + x - 1, head + y))
        x, y = px, py
    return out + back[::-1] + [(" ", len(old) - tail + i, len(new) - tail + i) for i in range(tail)]


def patch(old: list[str], new: list[str], edits: list[tuple[str, int, int]], context: int = CONTEXT) -> str:
    """Hunks of changed lines with lines around them."""
    changed = [i for i, (kind, _, _) in enumerate(edits) if kind != " "]
    out, at = [], 0
    while at < len(changed):
        end = at
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * context:
            end += 1
        part = edits[max(0, changed[at] - context) : changed[end] + context + 1]
        n_old, n_new = sum(k != "+" for k, _, _ in part), sum(k != "-" for k, _, _ in part)
        out.append(f"@@ -{part[0][1] + (n_old > 0)},{n_old} +{part[0][2] + (n_new > 0)},{n_new} @@")
        out += [kind + (new[j] if kind == "+" else old[i]) for kind, i, j in part]
        at = end + 1
    return "\n".join(out)


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n") if text else []


def _differences(batches):
    for batch in batches:
        rows: dict = {c.split(" ")[0]: [] for c in CHANGES.split(", ")}
        for path, old_path, status, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old, new = _lines(before), _lines(after)
            edits = script(old, new)
            whole = patch(old, new, edits).encode()
            for name, value in zip(rows, (path, old_path, status, sum(k == "+" for k, _, _ in edits), sum(k == "-" for k, _, _ in edits), whole[:PATCH_BYTES].decode(errors="ignore"), len(whole) > PATCH_BYTES), strict=True):
                rows[name].append(value)
        kinds = {"added": pa.int64(), "removed": pa.int64(), "cut": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()], names=list(rows))


def _shared(batches):
    for batch in batches:
        shares = []
        for before, after in zip(*(batch.column(c).to_pylist() for c in ("before", "after")), strict=True):
            old, new = Counter(_lines(before)), Counter(_lines(after))
            shares.append((old & new).total() / max(1, max(old.total(), new.total())))
        yield pa.RecordBatch.from_arrays([batch.column("gone"), batch.column("path"), pa.array(shares, pa.float64())], names=["gone", "path", "share"])


def renames(gone: DataFrame, new: DataFrame, share: float = RENAMED_FROM) -> DataFrame:
    """gone, new: (path, text). Rows (gone, path): each gone file with the new one that shares most lines with it, if they choose each other.

    Files meet by their lines that few others have: the three rarest of each, by hash.
    """
    lines = lambda df: df.select("path", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) <> ''")
    both = lines(gone).unionByName(lines(new))
    rare = both.groupBy("line").agg(F.count("*").alias("n")).where("n between 2 and 16")
    of = lambda df: lines(df).join(rare, "line").groupBy("path").agg(F.slice(F.sort_array(F.collect_set(F.struct("n", F.xxhash64("line").alias("h")))), 1, 3).alias("k")).select("path", F.explode("k").alias("k"))
    equal = gone.select(F.col("path").alias("gone"), F.sha2("text", 256).alias("h")).join(new.select("path", F.sha2("text", 256).alias("h")), "h").select("gone", "path")
    met = of(gone).withColumnRenamed("path", "gone").join(of(new), "k").select("gone", "path").unionByName(equal).distinct()
    texts = met.join(gone.select(F.col("path").alias("gone"), F.col("text").alias("before")), "gone").join(new.select("path", F.col("text").alias("after")), "path")
    scored = texts.select("gone", "path", "before", "after").mapInArrow(_shared, "gone string, path string, share double").where(F.col("share") >= share)
    first = lambda c, other: scored.groupBy(c).agg(F.max_by(other, F.struct("share", other)).alias(f"best_{other}"))
    return scored.join(first("gone", "path"), "gone").join(first("path", "gone"), "path").where("path = best_path and gone = best_gone").select("gone", "path")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: (path, text) of two versions. A row for each changed file: (path, old_path, status A, D, M or R, added, removed, patch, cut), the patch PATCH_BYTES at most."""
    both = old.select("path", F.col("text").alias("before")).join(new.select("path", F.col("text").alias("after")), "path", "full")
    changed = both.where(~F.col("before").eqNullSafe(F.col("after")))
    kept = changed.where("before is not null and after is not null").select("path", F.col("path").alias("old_path"), F.lit("M").alias("status"), "before", "after")
    gone, added = changed.where("after is null").select("path", F.col("before").alias("text")), changed.where("before is null").select("path", F.col("after").alias("text"))
    moved = renames(gone, added)
    renamed = moved.join(gone.select(F.col("path").alias("gone"), F.col("text").alias("before")), "gone").join(added.select("path", F.col("text").alias("after")), "path")
    renamed = renamed.select("path", F.col("gone").alias("old_path"), F.lit("R").alias("status"), "before", "after")
    nothing = F.lit(None).cast("string")
    only = gone.join(moved.select(F.col("gone").alias("path")), "path", "left_anti").select("path", F.col("path").alias("old_path"), F.lit("D").alias("status"), F.col("text").alias("before"), nothing.alias("after"))
    fresh = added.join(moved.select("path"), "path", "left_anti").select("path", nothing.alias("old_path"), F.lit("A").alias("status"), nothing.alias("before"), F.col("text").alias("after"))
    return kept.unionByName(renamed).unionByName(only).unionByName(fresh).mapInArrow(_differences, CHANGES)
