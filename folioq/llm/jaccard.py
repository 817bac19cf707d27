"""Near-duplicates by the similarity of their word windows: exact check of classes that share a bucket.

Texts whose sets of windows are equal are one class. A class enters the buckets that a join gives it;
classes that share a bucket are candidates. Joins (prefix_join, parity_join) give buckets so that similar sets
always share one. Every candidate pair is either checked exactly, by a join to
the windows of both, or lies in one component already, so no pair below the threshold
links and none is passed over.

In a bucket of many classes, pairs of the whole bucket are met only after some rounds
that check a few classes of the bucket against the others: what is linked by then needs no
further check, so a large group of near copies costs a few checks for each of its rows. First
among those few is the class whose buckets hold the most rows: copies edited apart from each
other have most in common with the text that they come from.
What is left of a bucket is cut into pieces of about PIECE rows that meet two by two, each
two in a task of their own, and comes out of one bucket that it shares (of many, one in each BEFORE at most). Before windows are fetched, two bounds that hold for every pair
of the threshold pass over others: the sizes of the sets, and the differing bits of their
parities (of the windows by hash, modulo PARITY), of which there are no more than windows in
one set only. Those of long texts differ in too few of PARITY bits to tell, so
parities of about a bit for each window are compared too, once for each two classes.

Defined results: null and blank texts have no windows and are one class; texts of fewer
words than a window have their whole word sequence; repeated rows are one class; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stored
from .simhash import components

SEED = 42
PARITY = 256
STARS = 2
ROUNDS = 4
PIECE = 1 << 11
SMALL = 32
BEFORE = 20


def windows(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the different windows of words, in order of hash."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), (ends[shingle - 1 :] if len(found) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(firsts, lasts, strict=True)), np.uint64, n))


def parity(hashes: np.ndarray) -> list[int]:
    """A bit for each remainder by PARITY: set if an odd number of windows has it."""
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide(hashes: np.ndarray) -> list[int]:
    """As parity, of as many bits as the next power of two has from the number of windows on; its halves' XOR is that of half the bits."""
    bits = max(PARITY, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _classes(shingle: int, buckets: Callable[[np.ndarray], list[int]]):
    def classes(batches):
        for batch in batches:
            found = [windows(t, shingle) for t in batch.column(2).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            lists = [pa.array(map(f, found), pa.list_(k)) for f, k in ((buckets, pa.int32()), (parity, pa.int64()), (wide, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), same, pa.array(map(len, found), pa.int64()), *lists], names=["doc_id", "key", "class", "size", "buckets", "parity", "wide"])

    return classes


def _sets(shingle: int):
    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([windows(t, shingle).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64())), *part.columns[2:]], names=["class", "windows", *part.schema.names[2:]])

    return sets


def closer(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs: (a, b); classes: (class, size, wide). Those pairs that can have percent by their wide parities, folded to the bits of the shorter one."""
    for c in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(c), F.col("size").alias(f"s{c}"), F.col("wide").alias(f"w{c}")), c)
    n, most = F.least(F.size("wa"), F.size("wb")), F.greatest(F.size("wa"), F.size("wb"))
    apart = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    folded = lambda w: F.when(F.size(w) > n, apart(F.slice(w, F.lit(1), n), F.slice(w, n + 1, n))).otherwise(F.col(w))
    differ = F.aggregate(apart(folded("wa"), folded("wb")), F.lit(0), lambda total, v: total + F.bit_count(v))
    return pairs.where(F.when(most > 2 * n, True).otherwise((100 + percent) * differ <= (100 - percent) * (F.col("sa") + F.col("sb")))).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: (x, y) of classes; sets: (class, windows, size, wide). Rows (a, b), a < b, of the different pairs of percent at least."""
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = closer(pairs, sets, percent)
    x, y = (sets.select(F.col("class").alias(c), F.col("windows").alias(f"w{c}")) for c in "ab")
    met = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("wa", "wb")).cast("long"))
    return met.where(100 * F.col("both") >= percent * (F.size("wa") + F.size("wb") - F.col("both"))).select("a", "b")


def _possible(x, y, percent: int) -> Column:
    """Whether two sets can have percent; x and y give a column of each by name."""
    total = (100 - percent) * (x("size") + y("size"))  # of windows in one set only, times 100 + percent
    differ = sum((F.bit_count(F.get(x("parity"), F.lit(i)).bitwiseXOR(F.get(y("parity"), F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return ((100 + percent) * F.abs(x("size") - y("size")) <= total) & ((100 + percent) * differ <= total)


def _met(left: DataFrame, percent: int) -> DataFrame:
    """left: (bucket, class, size, parity, root). Pairs (x, y) that a bucket holds, of different roots and possible; not where both have one of the BEFORE buckets before theirs in common, so the first that they share always gives them."""
    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(-BEFORE, -1)
    left = left.withColumn("before", F.collect_list("bucket").over(earlier))
    pieces = left.groupBy("bucket").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).where("pieces > 1")
    left = left.join(pieces, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    a = left.withColumns({"i": own, "j": others}).alias("a")
    b = left.withColumns({"j": own, "i": others}).alias("b")
    together = F.lit(True)
    for c in ("bucket", "i", "j"):
        together = together & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    possible = _possible(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), percent) & ~F.arrays_overlap("a.before", "b.before")
    pairs = a.join(b, together & (F.col("a.class") < F.col("b.class")) & (F.col("a.root") != F.col("b.root")) & possible)
    return pairs.select(F.col("a.class").alias("x"), F.col("b.class").alias("y"))


def links(texts: DataFrame, classes: DataFrame, percent: int, shingle: int, spread: Callable[[Column], Column]) -> DataFrame:
    """classes: (class, key, size, buckets, parity, wide). Rows (a, b) of classes of percent at least, whose components are those of all such pairs that share a bucket.

    spread: gives the buckets out of their stored form, for long lists of them.
    """
    held = classes.select("class", F.explode(spread(F.col("buckets"))).alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = stored(held.join(shared, "bucket"), "shared").join(classes.select("class", "size", "parity"), "class")
    left = stored(left.select("bucket", "class", "size", "parity", F.col("class").alias("root")), "buckets")
    # In a bucket of few classes, those that can have percent with no other need no bucket.
    sizes = left.groupBy("bucket").agg(F.count("*").alias("n"))
    small = left.join(sizes.where(F.col("n") <= SMALL).select("bucket"), "bucket", "left_semi")
    x, y = small.alias("x"), small.alias("y")
    near = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") < F.col("y.class")) & _possible(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent))
    near = near.select(F.col("x.bucket").alias("bucket"), F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    near = stored(near, "near")
    near = near.join(closer(near.select("a", "b").distinct(), classes, percent), ["a", "b"])
    near = near.select("bucket", F.explode(F.array("a", "b")).alias("class")).distinct()
    large = left.join(sizes.where(F.col("n") > SMALL).select("bucket"), "bucket", "left_semi")
    left = stored(small.join(near, ["bucket", "class"], "left_semi").select(*left.columns).unionByName(large.select(*left.columns)), "buckets")
    needed = classes.select("class", "key", "size", "wide").join(left.select("class").distinct(), "class")
    one = needed.join(texts, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("class", "text", "size", "wide")]).drop("key")  # a class has one key, a key one class
    sets = stored(one.mapInArrow(_sets(shingle), "class long, windows array<long>, size long, wide array<long>"), "windows")
    found = before = None
    for turn in range(ROUNDS + 1):
        # Buckets of one component are done; the others' pairs of two components, counted, tell whether another round pays.
        parts = left.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        cost = parts.where("roots > 1").agg(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
        if not cost["n"] or cost["pairs"] <= 2 * cost["n"] or turn == ROUNDS or before is not None and cost["pairs"] > before / 2:
            break
        before = cost["pairs"]
        # The class whose buckets hold the most rows has most in common with others: it is a star of each of its buckets, one round of each.
        if turn == 0:
            rows = left.groupBy("bucket").agg(F.count("*").alias("n"))
            centres = left.select("class", "bucket").join(rows, "bucket").groupBy("class").agg((-F.sum("n")).alias("h"))
            left = stored(left.join(centres, "class").select("bucket", "class", "size", "parity", "root", "h"), "buckets")
        orders = [F.col("h"), *(F.xxhash64("class", F.lit(3 * turn + i)) for i in range(1, STARS))]
        stars = left.groupBy("bucket").agg(F.array(*[F.min(F.struct(h.alias("h"), F.col("class"), F.col("root"), F.col("size"), F.col("parity"))) for h in orders]).alias("stars"))
        met = left.join(stars, "bucket").select("class", "root", "size", "parity", F.explode("stars").alias("s"))
        met = met.where((F.col("s.root") != F.col("root")) & _possible(lambda c: F.col(f"s.{c}"), F.col, percent))
        new = stored(similar(met.select(F.col("s.class").alias("x"), F.col("class").alias("y")), sets, percent), "similar")
        found = new if found is None else found.unionByName(new)
        roots = components(found).select(F.col("node").alias("class"), "root")
        now = left.drop("root").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        mixed = now.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct("h", "class")).alias("star")).where("least <> most").select("bucket", "star")
        now = now.join(mixed, "bucket").withColumn("h", F.when(F.col("class") == F.col("star.class"), 0).otherwise(F.col("h")))
        left = stored(now.select(*left.columns), "buckets")
    if not cost["n"]:
        return found if found is not None else left.select(F.col("class").alias("a"), F.col("root").alias("b"))
    new = similar(_met(left, percent), sets, percent)
    return new if found is None else found.unionByName(stored(new, "similar"))


def grouped(docs: DataFrame, doc_id: str, text: str, threshold: float, shingle: int, buckets: Callable[[np.ndarray], list[int]], spread: Callable[[Column], Column]) -> DataFrame:
    """Rows (doc_id, key, size, root) for each row of docs; rows of one root are near-duplicates, size is that of the set.

    buckets: 32-bit numbers of a set, which spread makes into what it meets others in.
    """
    texts = docs.select(row_key(F.lit(None), F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(F.lit(None), F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    rows = stored(rows.mapInArrow(_classes(shingle, buckets), "doc_id long, key string, class binary, size long, buckets array<int>, parity array<long>, wide array<long>"), "classes")
    classes = rows.groupBy(F.col("class").alias("same")).agg(F.min(F.struct("key", "size", "buckets", "parity", "wide")).alias("f"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "same", "f.*"), "classes")
    roots = components(links(texts, classes, round(100 * threshold), shingle, spread)).withColumnRenamed("node", "class")
    named = classes.select("class", "same").join(roots, "class", "left").select(F.col("same").alias("class"), F.coalesce("root", "class").alias("root"))
    return rows.select("doc_id", "key", "size", "class").join(named, "class").select("doc_id", "key", "size", "root")
