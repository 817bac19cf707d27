"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. It starts with one
bucket; a bucket whose bytes exceed the limit splits on its next bit, the others
stay as they are, until every bucket fits.

Bytes are summed once for cells of a fixed number of leading bits, some bits more
than the data needs on average. The sums of all shorter prefixes follow from the
cells; a cell's shard is its shortest prefix that fits. Cells that are still too
large go on for more bits, alone. Rows that agree in all 48 bits are equal rows:
such a bucket goes on in overflow pages that are cut by bytes.

Defined results: a null text has 0 bytes; a document above the limit is a shard of
its own, marked oversize; null ids and repeated rows are rows like others; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stored, table, top_bits

SHARD_BYTES = 64 << 20
SMALL_BYTES = 64 << 10
SPARE_BITS = 5
ALL_BITS = 48


def _round(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell (of high bits, bytes, n) the shortest prefix of low bits or more that fits, else null depth.

    The sums of each length follow from those of the next, so a level costs one small aggregation.
    """
    levels = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "bytes", "n")
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_n"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_n") == 1))
    found = levels.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"], "left")
    best = F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "prefix", "shard_bytes", "shard_n")))
    return found.groupBy("cell").agg(best.alias("best")).select("cell", "best.*")


def directory(keys: DataFrame, limit: int, spare_bits: int = SPARE_BITS) -> tuple[DataFrame, list[int]]:
    """keys: (key, bytes). The directory (bits, cell, depth, prefix, shard_bytes, shard_n) and the cell widths used."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    bits = min(ALL_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + spare_bits)
    low, widths, parts, rest = 0, [], [], keys
    while True:
        cells = rest.groupBy(top_bits(F.col("key"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        found = stored(_round(cells, low, bits, limit), "directory")
        widths.append(bits)
        open_cells = found.where("depth is null").select("cell")
        if bits == ALL_BITS or open_cells.isEmpty():
            parts.append(found.withColumn("bits", F.lit(bits)))
            break
        parts.append(found.where("depth is not null").withColumn("bits", F.lit(bits)))
        rest = rest.join(open_cells, top_bits(F.col("key"), bits) == F.col("cell"), "left_semi")
        low, bits = bits + 1, min(ALL_BITS, bits + 8)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, widths


def shard(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text", spare_bits: int = SPARE_BITS, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc (a struct of its columns, or of those in keep), n_bytes, shard (its bits), shard_bytes, oversize."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
        row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    found, widths = directory(rows.select("key", F.col("n_bytes").alias("bytes")), limit, spare_bits)
    named = found.withColumn("shard", F.when(F.col("depth").isNotNull(), F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))")))
    out, rest = None, rows
    for width in widths:
        cells = named.where(F.col("bits") == width).select("cell", "shard", "shard_bytes")
        cell = top_bits(F.col("key"), width)
        part = rest.join(cells, cell == F.col("cell"), "inner").drop("cell")
        out = part if out is None else out.unionByName(part)
        if width != widths[-1]:
            rest = rest.join(cells.select("cell"), cell == F.col("cell"), "left_anti")
    # Overflow pages of equal rows: dealt out first, so that no window holds more than about a page.
    placed = out.where("shard is not null")
    if widths[-1] == ALL_BITS:
        same = out.where("shard is null").drop("shard", "shard_bytes")
        sums = same.groupBy("key").agg((F.floor(F.sum("n_bytes") / limit) + 1).alias("deals"))
        dealt = same.join(sums, "key").withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.col("deals")))
        rows_a_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes"))))
        page = F.floor((F.row_number().over(Window.partitionBy("key", "deal").orderBy("n_bytes")) - 1) / rows_a_page)
        paged = dealt.withColumn("shard", F.concat_ws("-", F.lpad(F.bin(top_bits(F.col("key"), ALL_BITS)), ALL_BITS, "0"), F.col("deal").cast("string"), page.cast("string")))
        paged = paged.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("key", "deal", "shard"))).drop("deals", "deal")
        placed = placed.unionByName(paged)
    return placed.select("doc", "n_bytes", "shard", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def op6_byte_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, keep=["doc_id"]).select("doc.doc_id", "n_bytes", "shard", "shard_bytes", "oversize")


def shards_of_64_kib(spark, sf_dir):
    """Shards of a limit at which small tables split, too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, SMALL_BYTES, keep=["doc_id"]).select("doc.doc_id", "n_bytes", "shard", "shard_bytes", "oversize")


_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS key
  FROM documents),
levels AS (SELECT *, key >> (48 - depth) AS prefix FROM rows, range(0, 25) t(depth)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM levels GROUP BY ALL),
best AS (
  SELECT l.doc_id, l.key, min(l.depth) AS depth FROM levels l JOIN sums s USING (depth, prefix)
  WHERE s.shard_bytes <= LIMIT OR s.n = 1 GROUP BY ALL)
SELECT r.doc_id, r.n_bytes, CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(r.key >> (48 - b.depth)), b.depth::INTEGER, '0') END AS shard,
       s.shard_bytes, s.shard_bytes > LIMIT AS oversize
FROM rows r JOIN best b ON r.doc_id IS NOT DISTINCT FROM b.doc_id AND r.key = b.key
JOIN sums s ON s.depth = b.depth AND s.prefix = r.key >> (48 - b.depth)
"""
SQL = _SQL.replace("LIMIT", str(SHARD_BYTES))
SQL_SMALL = _SQL.replace("LIMIT", str(SMALL_BYTES))
