"""Token counts of documents in flat token files that have no index.

A token file is a plain run of fixed-width little-endian numbers; every document ends
with one separator. Files are cut into blocks that tasks read at their offsets and
search for separators with vector operations. A block knows the documents that lie
inside it, the tokens before its first separator and those after its last. A prefix
scan over the blocks then gives the number of documents before each block and stitches
documents that cross blocks, however many they span. The scan has two levels: blocks
within runs of RUN_BLOCKS, then the runs of a file, so a file of any size keeps every
window short; the lengths found in a block stay with it and are no part of the scan.

Writing is a job of its own: tasks encode texts with a public tokenizer whose file is a
parameter, append them to one file each, and return which document is which in it.

Defined results: null and empty texts are documents of 0 tokens; tokens after the last
separator are a last document that is not ended; an empty file, folder or table gives
no rows; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import make_folder, read_bytes, writing
from .common import scratch, stored, table

BLOCK_BYTES = 8 << 20
RUN_BLOCKS = 1024
WIDTH = "<u2"


@lru_cache(1)
def encoding(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def write_token_files(docs: DataFrame, folder: str, ranks_file: str, pattern: str, separator: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a file of tokens for each task. Rows (file, place, doc_id): the place-th document of the file, from 0."""

    def write(batches):
        encode, _ = encoding(ranks_file, pattern)
        name, place = f"tokens-{TaskContext.get().partitionId():06d}", 0
        first = next(batches, None)
        if first is None:
            return
        with writing(f"{folder}/{name}.bin") as out:
            for batch in chain([first], batches):
                for t in batch.column(1).to_pylist():
                    out.write(np.array([*encode.encode_ordinary(t or ""), separator], WIDTH).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), pa.array(np.arange(place, place + batch.num_rows)), batch.column(0)], names=["file", "place", "doc_id"])
                place += batch.num_rows

    make_folder(folder)
    return stored(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(write, "file string, place long, doc_id long"), "places")


def _searched(separator: int, width: str):
    def search(batches):
        for batch in batches:
            out: dict = {k: [] for k in ("file", "block", "ends", "head", "tail", "inner")}
            for row in batch.to_pylist():
                tokens = read_bytes(row["path"], row["start"], row["size"]).view(width)
                ends = np.flatnonzero(tokens == separator)
                out["file"].append(row["file"])
                out["block"].append(row["block"])
                out["ends"].append(len(ends))
                out["head"].append(int(ends[0]) if len(ends) else 0)
                out["tail"].append(len(tokens) - (int(ends[-1]) + 1 if len(ends) else 0))
                out["inner"].append(np.diff(ends) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(out["file"], pa.string()), *(pa.array(out[k], pa.int64()) for k in ("block", "ends", "head", "tail")), pa.array(out["inner"], pa.list_(pa.int64()))], names=list(out))

    return search


def count_tokens(spark: SparkSession, folder: str, separator: int, width: str = WIDTH, block_bytes: int = BLOCK_BYTES, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Rows (file, place, n_tokens, ended) for each document of the files in folder."""
    block_bytes -= block_bytes % np.dtype(width).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")  # names and sizes only
    blocks = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    start = F.col("block") * block_bytes
    blocks = blocks.select("path", F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("file"), "block", start.alias("start"), F.least(F.lit(block_bytes), F.col("length") - start).alias("size"))
    facts = blocks.repartition("file", "block").mapInArrow(_searched(separator, width), "file string, block long, ends long, head long, tail long, inner array<long>")
    facts = stored(facts, "blocks")
    scanned = _scanned(facts.select("file", "block", "ends", "head", "tail"), run_blocks)
    ended = scanned.where("ends > 0").join(facts.select("file", "block", "inner"), ["file", "block"])
    sizes = F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    whole = ended.select("file", "before", F.posexplode(sizes).alias("at", "n_tokens")).select("file", (F.col("before") + F.col("at")).alias("place"), "n_tokens", F.lit(True).alias("ended"))
    last = F.max(F.struct("block", (F.col("before") + F.col("ends")).alias("place"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens"))).alias("last")
    rest = scanned.groupBy("file").agg(last).select("file", "last.place", "last.n_tokens", F.lit(False).alias("ended")).where("n_tokens > 0")
    return whole.unionByName(rest)


def _scan(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with before (separators in earlier rows), open (tokens in earlier rows since the last of them) and closed (whether there is one).

    past is the tokens after the last separators of all earlier rows; the part of it that a later separator has closed is its value at the last row with one.
    """
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = rows.withColumn("past", zero(F.sum("tail").over(earlier))).withColumn("before", zero(F.sum("ends").over(earlier)))
    done = F.max(F.when(F.col("ends") > 0, F.col("past"))).over(earlier)
    return rows.withColumn("open", F.col("past") - zero(done)).withColumn("closed", done.isNotNull())


def _scanned(blocks: DataFrame, run_blocks: int) -> DataFrame:
    """blocks: (file, block, ends, head, tail). With before (separators earlier in the file) and carry (tokens that an open document brings along)."""
    inside = _scan(blocks.withColumn("run", F.expr(f"block div {run_blocks}")), ["file", "run"], "block")
    tail = F.sum("tail") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("past"))), F.lit(0).cast("long"))
    runs = stored(inside.groupBy("file", "run").agg(F.sum("ends").alias("ends"), tail.alias("tail")), "runs")
    runs = _scan(runs, ["file"], "run").select("file", "run", F.col("before").alias("run_before"), F.col("open").alias("run_open"))
    carry = F.col("open") + F.when(F.col("closed"), F.lit(0).cast("long")).otherwise(F.col("run_open"))
    return inside.join(runs, ["file", "run"]).select("file", "block", "ends", "head", "tail", (F.col("run_before") + F.col("before")).alias("before"), carry.alias("carry"))


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    ranks_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    separator = 50256  # the free number of this vocabulary
    folder = scratch(spark, "tokens")
    places = write_token_files(table(spark, sf_dir, "documents"), folder, ranks_file, pattern, separator)
    counts = count_tokens(spark, folder, separator)
    return places.join(counts, ["file", "place"]).select("doc_id", "n_tokens", "ended")
