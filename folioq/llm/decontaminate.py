"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents of one task, about shard_words words. Its text is
reduced to the phrases' alphabet: words of no phrase become one symbol, and runs of
known words that are shorter than the shortest phrase fall away, which loses no
occurrence. The rest is indexed (suffix order, wavelet ranks, sampled positions); all
phrases are searched backward at once, occurrences located, and the spans merged.

A benchmark of block_bytes at most goes to the tasks with the job. A larger one is written
to the shared folder by Spark, in blocks of that size and with its words in order of
hash; each shard is indexed once, over the words of all blocks, and searched for one block
after another. A word is found by its hash and then compared itself, so words that share a hash
stay apart. Nothing of the benchmark passes the driver.

Defined results: null and blank texts have no words and no hits; a null or blank item
has no window; equal items under several ids all count; a null item id counts as an
empty string; repeated rows get equal results; no items: nothing is hit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import load, save
from .common import row_key, scratch, table
from .fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 4 << 20
MOST_KNOWN = 2_000_000
#: Bytes of words are digits, a-z and all above ASCII; A-Z count as a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SPANS = "array<struct<start: long, stop: long>>"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The windows of some items, as numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: list[str] = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        lines, owner = [], []
        for at, (_, text) in enumerate(items):
            known = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in split_words(text)]
            for start in range(max(1, len(known) - window + 1) if known else 0):
                lines.append(known[start : start + window])
                owner.append(at)
        self.owner = np.array(owner, np.int64)
        self.lengths = np.array([len(x) for x in lines], np.int64)
        self.windows = np.zeros((len(lines), window), np.int64)
        for row, line in enumerate(lines):
            self.windows[row, window - len(line) :] = line
        self.shortest = int(self.lengths.min()) if lines else 0

    def coded(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, found, repeat(1)), np.int32, len(found))

    def blocks(self):
        return [self]


class StoredPhrases:
    """Phrases in the shared folder. Words are numbered by the order of their hashes; the numbers of all blocks agree."""

    def __init__(self, folder: str, blocks: list[int], ranges: list[int], shortest: int):
        self.folder, self.numbers, self.shortest = folder, blocks, shortest
        self.lexicon = Lexicon([load(f"{folder}/words-{r}") for r in sorted(ranges)])
        self.known: dict[bytes, int] = {}

    def coded(self, found: list[bytes]) -> np.ndarray:
        new = [w for w in set(found) if w not in self.known]
        if new:
            if len(self.known) > MOST_KNOWN:
                self.known, new = {}, list(set(found))
            self.known.update(zip(new, self.lexicon.numbers(new).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))

    def blocks(self):
        for b in self.numbers:
            arrays = load(f"{self.folder}/block-{b}")
            names = arrays["ids"].tobytes().decode().split("\0")
            yield SimpleNamespace(windows=arrays["windows"].reshape(len(arrays["lengths"]), -1), lengths=arrays["lengths"], owner=arrays["owner"], ids=names)


def hashed(word: bytes, bits: int = 64) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - bits)


class Lexicon:
    """The words of all phrases in order of hash and word, in parts by hash."""

    def __init__(self, parts: list[dict[str, np.ndarray]]):
        self.parts = parts
        self.bits = int(parts[0]["bits"][0]) if parts else 64
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(p["hashes"] for p in parts)])
        self.begins = np.cumsum([0, *(len(p["hashes"]) for p in parts)])

    def word(self, at: int) -> bytes:
        part = int(np.searchsorted(self.begins, at, side="right")) - 1
        ends, i = self.parts[part]["ends"], at - int(self.begins[part])
        return self.parts[part]["letters"][ends[i - 1] if i else 0 : ends[i]].tobytes()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word: 2 and up for those of the phrases, else 1."""
        out = np.ones(len(words), np.int64)
        if not len(self.hashes):
            return out
        asked = np.fromiter((hashed(w, self.bits) for w in words), np.uint64, len(words))
        first, after = (np.searchsorted(self.hashes, asked, side=x) for x in ("left", "right"))
        for i in np.flatnonzero(first < after).tolist():
            out[i] = next((at + 2 for at in range(int(first[i]), int(after[i])) if self.word(at) == words[i]), 1)
        return out


def stored_phrases(items: DataFrame, blocks: int, window: int, hash_bits: int = 64) -> tuple:
    """items: (id, text), written by Spark. What StoredPhrases takes."""
    folder = scratch(items.sparkSession, "phrases")

    def split(batches):
        for batch in batches:
            found = sorted({w for t in batch.column(0).to_pylist() for w in split_words(t)})
            yield pa.RecordBatch.from_arrays([pa.array([hashed(w, hash_bits) >> max(0, hash_bits - 4) for w in found], pa.int64()), pa.array(found, pa.binary())], names=["range", "word"])

    def write_words(rows: pa.Table) -> pa.Table:
        found = sorted((hashed(w, hash_bits), w) for w in rows.column("word").to_pylist())
        arrays = {"hashes": np.array([h for h, _ in found], np.uint64), "ends": np.cumsum([len(w) for _, w in found]), "letters": np.frombuffer(b"".join(w for _, w in found), np.uint8), "bits": np.array([hash_bits])}
        save(f"{folder}/words-{rows.column('range')[0].as_py()}", arrays)
        return pa.table({"range": rows.column("range")[:1]})

    words = items.select("text").mapInArrow(split, "range long, word binary").distinct()
    ranges = [r["range"] for r in words.groupBy("range").applyInArrow(write_words, "range long").collect()]  # 16 at most

    def write_block(rows: pa.Table) -> pa.Table:
        block = Phrases(list(zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True)), window)
        renumbered = np.concatenate(([0, 1], StoredPhrases(folder, [], ranges, 0).lexicon.numbers(list(block.vocabulary)))).astype(np.int64)
        save(f"{folder}/block-{rows.column('b')[0].as_py()}", {"windows": renumbered[block.windows].ravel(), "lengths": block.lengths, "owner": block.owner, "ids": np.frombuffer("\0".join(block.ids).encode(), np.uint8)})
        return pa.table({"b": rows.column("b")[:1], "shortest": pa.array([block.shortest], pa.int64())})

    made = items.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long")).groupBy("b").applyInArrow(write_block, "b long, shortest long").where("shortest > 0").collect()  # a number for each block
    return folder, sorted(r["b"] for r in made), ranges, min((r["shortest"] for r in made), default=0)


@lru_cache(1)
def opened(folder: str, blocks: tuple, ranges: tuple, shortest: int) -> StoredPhrases:
    return StoredPhrases(folder, list(blocks), list(ranges), shortest)


def search_shard(texts: list[str | None], phrases: Phrases | StoredPhrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: number of words, merged spans of hit words, ids of items with an occurrence."""
    sizes, coded = [], []
    for text in texts:
        found = split_words(text)
        sizes.append(len(found))
        coded.append(phrases.coded(found))
        coded.append(np.ones(1, np.int32))  # documents don't run into each other
    sizes = np.array(sizes, np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not phrases.shortest or not sizes.sum():
        return sizes, spans, items
    symbols = np.concatenate(coded)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (symbols > 1).astype(np.int8), [0]))))
    first, last = edges[::2], edges[1::2]
    long = last - first >= phrases.shortest
    first, last = first[long], last[long]
    if not len(first):
        return sizes, spans, items
    keep = np.zeros(len(symbols) + 1, np.int8)
    np.add.at(keep, first, 1)
    np.add.at(keep, last, -1)
    inside = np.cumsum(keep[:-1]) > 0
    inside[last[last < len(symbols)]] = True  # the word after a run parts it from the next
    place = np.flatnonzero(inside)
    index = FMIndex(np.concatenate((symbols[place], [1, 0])).astype(np.int64))
    cover = np.zeros(len(symbols) + 1, np.int64)
    for block in phrases.blocks():
        low, high = index.search(block.windows, block.lengths)
        hits = np.flatnonzero(low < high)
        counts = (high - low)[hits]
        if not len(hits):
            continue
        rows = np.repeat(low[hits], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        which = np.repeat(hits, counts)
        at = place[index.locate(rows)]
        document = np.searchsorted(starts, at, side="right") - 1
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.lengths[which], -1)
        for d, i in np.unique(np.stack((document, block.owner[which]), axis=1), axis=0).tolist():
            items[d].append(block.ids[i])
    hit = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))
    turns = np.flatnonzero(np.diff(hit))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    return sizes, spans, [sorted(set(x)) for x in items]


def _searched(rows: DataFrame, phrases_of: Callable[[], Phrases | StoredPhrases], shard_words: int) -> DataFrame:
    """rows: (doc_id, key, text). Rows (doc_id, key, n_words, spans, items)."""

    def searched(batches):
        phrases = phrases_of()

        def emit(held):
            texts = [t for b in held for t in b.column(2).to_pylist()]
            sizes, spans, found = search_shard(texts, phrases)
            ids = pa.concat_arrays([b.column(0) for b in held])
            keys = pa.concat_arrays([b.column(1) for b in held])
            pairs = [[{"start": a, "stop": b} for a, b in s] for s in spans]
            kinds = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([ids, keys, pa.array(sizes), pa.array(pairs, kinds[0]), pa.array(found, kinds[1])], names=["doc_id", "key", "n_words", "spans", "items"])

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                size += part.column(2).nbytes // 6
                if size >= shard_words:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return rows.mapInArrow(searched, f"doc_id long, key string, n_words long, spans {SPANS}, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """Rows (doc_id, key, n_words, n_hit, spans, items), one for each row of docs; spans are merged and in order."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{item_text}`").alias("text"))
    blocks = math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) / block_bytes)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(F.lit(None), F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    if blocks == 1:
        phrases = Phrases([tuple(r) for r in items.collect()], window)  # block_bytes at most
        out = _searched(rows, lambda: phrases, shard_words)
    else:
        folder, numbers_, ranges, shortest = stored_phrases(items, blocks, window, hash_bits)
        out = _searched(rows, lambda: opened(folder, tuple(numbers_), tuple(ranges), shortest), shard_words)
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a window of an item."""
    hit = decontaminate(docs, benchmark, doc_id, text, **options).where("n_hit > 0").select(F.col("key").alias("hit_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(F.lit(None), F.col(f"`{text}`")).alias("hit_key"))
    return rows.join(hit, "hit_key", "left_anti").select("doc.*")


def op5_benchmark_hits(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT item_id, array_to_string(ws[s:s + 9], ' ') AS g, least(10, len(ws)) AS n
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM i WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lengths)),
met AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM places p JOIN windows w USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM (SELECT DISTINCT doc_id, s, n FROM met)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
