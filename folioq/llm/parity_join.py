"""Join of texts by the Jaccard similarity of their shingles, with parity sketches.

A text's set are its different shingles of SHINGLE words. A sketch has a bit for each
place that a shingle can hash to, and a shingle flips its bit; sketches of two sets differ
in no more bits than there are shingles in one set only. Of two sets of a and b shingles
with a similarity of t at least those are (1 - t) / (1 + t) * (a + b) at most.

Sizes fall into bands, each up to 1 / t^STEPS times its least size, so similar sets are of one
band or of two that follow. A band has sketches of D + 1 words of 64 bits, D being the most
bits that similar sets up to its greatest size differ in. By the pigeonhole principle such
sketches agree in a word: each set enters its words for its own band, and for the next if a
similar set can lie there, and texts meet where a band's word of one number has one value. No
similar pair is passed over. Pairs that meet are compared by size and by a short sketch,
and those left exactly, as in jaccard: equal sets are one class, a large group is linked
through a few of its classes, and what stays apart meets in pieces.

Defined results: null and blank texts have an empty set and are linked with nothing; texts
of fewer words than a shingle have their whole sequence; repeated rows link to each other;
rows with a null id join their component, whose id is the smallest id that is not null
(null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import grouped
from .common import table

SHINGLE = 3
THRESHOLD = 0.9
STEPS = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1 << 12)
def band(size: int, percent: int) -> tuple[int, int, int]:
    """The number of the band that holds size, with its least and its largest size."""
    number, low = 0, 1
    while True:
        high = low
        for _ in range(STEPS):
            high = 100 * high // percent
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


def most_apart(high: int, percent: int) -> int:
    """The most shingles in one set only, of two sets of high shingles at most with percent at least."""
    return (100 - percent) * 2 * high // (100 + percent)


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """A sketch of so many words of 64 bits."""
    out = np.zeros(words, np.uint64)
    place = hashes % np.uint64(64 * words)
    np.bitwise_xor.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def signatures(hashes: np.ndarray, percent: int) -> list[int]:
    """The set's band, the number of words of its sketch there, and those words, then for a set that has similar ones in the next band its words there; each word is hashed to 32 bits."""
    n = len(hashes)
    if not n:
        return []
    number, _, high = band(n, percent)
    sizes = [high] + [band(high + 1, percent)[2]] * (100 * n // percent > high)
    found = [sketch(hashes, most_apart(x, percent) + 1) for x in sizes]
    h = np.concatenate(found) * _MIX
    h = ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32)
    return [number, len(found[0]), *h.view(np.int32).tolist()]


def buckets(b: Column) -> Column:
    """A bucket for each word: of its band, its number and its value."""
    band_, own = F.get(b, F.lit(0)), F.get(b, F.lit(1))
    of = lambda band_: lambda v, i: F.xxhash64(band_, i, v)
    return F.concat(F.transform(F.slice(b, 3, own), of(band_)), F.transform(F.slice(b, own + 3, F.size(b)), of(band_ + 1)))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, key, n_shingles, component_id) for each row of docs."""
    percent = round(100 * threshold)
    rows = grouped(docs, doc_id, text, threshold, shingle, lambda hashes: signatures(hashes, percent), buckets)
    least = rows.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", "key", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_jaccard_join(spark, sf_dir):
    return joined(table(spark, sf_dir, "documents")).drop("key")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * met.n >= 90 * (a.n + b.n - met.n)),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.root)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
