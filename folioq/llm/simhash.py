"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed where the text is and collapse to distinct values, so exact
copies and texts with equal fingerprints cost one row. The 64 bits are cut into
segments. Two fingerprints within max_distance bits differ in at most
max_distance // segments bits in at least one segment. Each fingerprint therefore
enumerates the Hamming ball of that radius around each of its segments, fetches the
table's fingerprints with such a segment value by an equi-join, and verifies the
complete distance inside the join. Connected components follow by contraction of the
verified links; each round is written to the shared folder.

A fingerprint has at most 679121 others within four bits, however many rows its group has,
so links grow with the number of different fingerprints.

Defined results: null and blank texts have fingerprint zero and link like any other;
texts of fewer words than a shingle hash their whole word sequence; repeated rows link
to each other; rows with a null id join their component, whose id is the smallest id
that is not null (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored, table

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: Above so many different fingerprints, balls of two bits in two segments fetch fewer candidates than those of one bit in three.
MANY = 1 << 25
BITS = 64
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), (ends[shingle - 1 :] if len(found) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(firsts[at : at + BLOCK], lasts[at : at + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, key, fp): key tells rows of one id apart by their text."""

    def hashed(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(F.lit(None), F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, key string, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    width, more = divmod(BITS, segments)
    widths = [width + (i < more) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _value(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _around(s: int, value: Column):
    return lambda mask: F.struct(F.lit(s).alias("s"), value.bitwiseXOR(mask).alias("v"))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, segments: int | None = None) -> DataFrame:
    """fps: distinct fp. Rows (a, b), a < b, of fingerprints within max_distance bits; the number of segments, unset, goes by that of fingerprints."""
    segments = segments or (3 if fps.count() <= MANY else 2)
    radius = max_distance // segments
    entries, probes = [], []
    for s, (low, width) in enumerate(_segments(segments)):
        value = _value(F.col("fp"), low, width)
        entries.append(F.struct(F.lit(s).alias("s"), value.alias("v")))
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        probes.append(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), _around(s, value)))
    held = fps.select(F.col("fp").alias("b"), F.explode(F.array(*entries)).alias("e")).select("b", "e.*")
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("e")).select("a", "e.*")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    met = asked.alias("x").join(held.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.v") == F.col("y.v")) & near)
    return met.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Rows (node, root) with the smallest node of each connected component.

    Every round each node points to its smallest neighbour if that is smaller than itself,
    pointers are followed to their ends, and the links are carried over to those ends.
    Links inside a group are gone then, so each link is joined in few rounds.
    """
    edges = stored(edges.select("a", "b"), "edges")
    found = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ups = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "ups")
        while True:
            further = ups.join(ups.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            further = stored(further, "ups")
            ups = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        later = ups.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = ups if found is None else stored(found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        met = edges.join(ups.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(ups.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = stored(met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE, segments: int | None = None) -> DataFrame:
    """Rows (doc_id, key, fp, root, component_id) for each row of docs."""
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(classes.select("fp"), max_distance, segments))
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root"), "fp")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", find=grouped, **options) -> DataFrame:
    """docs with one row of each component that find gives: that of the smallest id, then of the smallest key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key")))
    named = lambda i, key: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), key).alias("kept")
    kept = find(docs, doc_id, text, **options).groupBy("root").agg(first.alias("first")).select(named(F.col("first.doc_id"), F.col("first.key")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), named(F.col(f"`{doc_id}`").cast("long"), row_key(F.lit(None), F.col(f"`{text}`"))))
    # The join deals rows by the column that repeated ones are dropped by, so texts are shuffled once.
    return rows.join(kept.hint("merge"), "kept").dropDuplicates(["kept"]).select("doc.*")


def op3_near_duplicates(spark, sf_dir):
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
