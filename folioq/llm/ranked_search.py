"""The best documents of each item by a lexical score, found by groups of documents that match the same terms.

Every text is split once: of a document the number of its terms and the places of the items'
terms in it go to the shared folder. Sums over all documents give N, L and each term's df.
Then a task takes its documents a batch at a time. For an item, bitmap operations give each
document its presence mask (a bit for each of the item's terms); documents of one mask
are a group. No document of a group scores more than its terms' largest shares of the
batch, so masks are evaluated by descending maximum, and the rest of a batch is finished
when the next maximum is below the k-th score so far. A task gives k rows for each item at
most, which meet in two steps.

Items go to the tasks in blocks of about BLOCK_TERMS terms; each block takes a pass over the texts.

Defined results: null and blank texts have no term and are no documents; an item's terms are
those of all rows of its id, once each; a null item id is an id; items without terms, or of terms
that no document has, have no rows; each row of docs is a document, also if repeated; equal
scores go by ascending doc_id, null last; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

TOP = 50
BLOCK_TERMS = 200_000
FANS = 64
#: Terms are runs of digits, letters and whatever is above ASCII; A-Z count as a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SCORED = "item long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (item_id, term), without repeats."""

    def split(batches):
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([t.decode() for x in found for t in x], pa.string())], names=["item_id", "term"])

    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(split, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


def matched(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """docs: (doc_id, text). Rows (doc_id, n, terms, tfs) of the texts with terms: their number, the numbered ones in order and how often each stands there."""

    def counted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, sets, tfs = [], [], []
                for text in part.column(1).to_pylist():
                    found = terms(text)
                    codes = np.fromiter((x for x in map(numbers.get, found) if x is not None), np.int64)
                    own, n = np.unique(codes, return_counts=True)
                    sizes.append(len(found))
                    sets.append(own)
                    tfs.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(counted, "doc_id long, n long, terms array<long>, tfs array<long>").where("n > 0")


class Batch:
    """The postings of some documents, by term."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, codes: np.ndarray, tfs: np.ndarray, documents: int, length: int):
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.codes = codes
        m = 50 + (50 * n * documents) // length
        rows = np.repeat(np.arange(len(n)), counts)
        self.shares = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[rows])
        order = np.argsort(codes, kind="stable")
        self.rows, by_term = rows[order], codes[order]
        self.kinds, self.firsts = np.unique(by_term, return_index=True)
        self.lasts = np.append(self.firsts[1:], len(by_term))
        self.most = np.maximum.reduceat(self.shares[order], self.firsts) if len(by_term) else self.firsts

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """A row of 64-bit words for each document: bit j is set if it holds codes[j]."""
        out = np.zeros((len(self.starts) - 1, -(-len(codes) // 64)), np.uint64)
        at = np.searchsorted(self.kinds, codes)
        for j, (k, code) in enumerate(zip(at.tolist(), codes.tolist(), strict=True)):
            if k < len(self.kinds) and self.kinds[k] == code:
                out[self.rows[self.firsts[k] : self.lasts[k]], j >> 6] |= np.uint64(1 << (j & 63))
        return out

    def largest(self, codes: np.ndarray) -> np.ndarray:
        """The largest share of each term in a document of the batch."""
        at = np.minimum(np.searchsorted(self.kinds, codes), max(0, len(self.kinds) - 1))
        return np.where(self.kinds[at] == codes, self.most[at], 0) if len(self.kinds) else np.zeros(len(codes), np.int64)

    def scores(self, documents: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of documents (which hold some of the terms): the sum of their shares by the weights of terms."""
        counts = self.starts[documents + 1] - self.starts[documents]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) + np.repeat(self.starts[documents] - ends + counts, counts)
        return np.add.reduceat(self.shares[at] * weights[self.codes[at]], ends - counts)


def best_first(batch: Batch, ids: np.ndarray, known: np.ndarray, codes: np.ndarray, weights: np.ndarray, held: tuple, k: int) -> tuple[tuple, int]:
    """held: scores, null marks and ids of the best documents so far, in order. With those of the batch, and how many of its documents were scored.

    weights has a weight for each numbered term, 0 for those that the item doesn't have.
    """
    masks = batch.masks(codes)
    hits = np.flatnonzero(masks.any(axis=1))
    if not len(hits):
        return held, 0
    if masks.shape[1] == 1:
        kinds, group = np.unique(masks[hits, 0], return_inverse=True)
        kinds = kinds[:, None]
    else:
        kinds, group = np.unique(masks[hits], axis=0, return_inverse=True)
    bits = np.unpackbits(kinds.view(np.uint8), axis=1, bitorder="little")[:, : len(codes)]
    most = bits.astype(np.int64) @ (weights[codes] * batch.largest(codes))
    order = np.argsort(-most, kind="stable")
    members = hits[np.argsort(group.ravel(), kind="stable")]
    sizes = np.bincount(group.ravel(), minlength=len(kinds))
    firsts = np.cumsum(sizes) - sizes
    at = done = 0
    step = max(2 * k, 64)
    while at < len(order):
        if len(held[0]) == k and most[order[at]] < held[0][-1]:
            break
        until, taken = at, 0
        while until < len(order) and taken < step:  # whole masks, about step documents
            taken += sizes[order[until]]
            until += 1
        chosen = np.concatenate([members[firsts[g] : firsts[g] + sizes[g]] for g in order[at:until].tolist()])
        scores = batch.scores(chosen, weights)
        chosen, scores = chosen[scores > 0], scores[scores > 0]
        done += taken
        joined = (np.append(held[0], scores), np.append(held[1], known[chosen]), np.append(held[2], ids[chosen]))
        first = np.lexsort((joined[2], joined[1], -joined[0]))[:k]
        held = tuple(x[first] for x in joined)
        at, step = until, 2 * step
    return held, done


def _ranked(postings: DataFrame, codes: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """postings: rows of matched. Rows (item, doc_id, score), k for each task and item at most."""

    def ranked(batches):
        none = np.zeros(0, np.int64)
        best = [(none, none.astype(bool), none)] * len(codes)
        own = np.zeros(len(weights), np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            ids, n = (rows.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1))
            no_id = rows.column(0).is_null().to_numpy(zero_copy_only=False)
            lists = rows.column(2)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            batch = Batch(n, counts, lists.flatten().to_numpy(), rows.column(3).flatten().to_numpy(), documents, length)
            for i, c in enumerate(codes):
                own[c] = weights[c]
                best[i], _ = best_first(batch, ids, no_id, c, own, best[i], k)
                own[c] = 0
        for i, (scores, no_id, ids) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids, mask=no_id), pa.array(scores)], names=["item", "doc_id", "score"])

    return postings.mapInArrow(ranked, SCORED)


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item, rank from 1."""
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_id, item_text), "terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts, sums = [], None
    for b in range(blocks):
        of_block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = of_block.collect()  # about block_terms terms
        numbers = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in rows}))}
        ids = {x: i for i, x in enumerate(dict.fromkeys(r["item_id"] for r in rows))}
        codes: list[list[int]] = [[] for _ in ids]
        for r in rows:
            codes[ids[r["item_id"]]].append(numbers[r["term"].encode()])
        postings = stored(matched(texts, numbers), "postings")
        sums = sums or postings.agg(F.count("*"), F.sum("n")).first()
        if not sums[0] or not rows:
            continue
        df = np.zeros(len(numbers), np.int64)
        for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
            df[term] = n
        weights = np.floor(1000 * np.log((2 * sums[0] + 2) / (2 * df + 1))).astype(np.int64)
        rows = _ranked(postings, [np.sort(np.array(c, np.int64)) for c in codes], weights, sums[0], sums[1], k)
        named = spark.createDataFrame([(i, x) for x, i in ids.items()], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = Window.partitionBy("item", "fan").orderBy(*best)
        rows = rows.withColumn("fan", F.spark_partition_id() % FANS).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
        parts.append(rows.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))  # an id for each item of the block
    if not parts:
        return asked.where("false").select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_ranked_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, r, ts, len(ts)::BIGINT AS n FROM split WHERE len(ts) > 0),
sums AS (SELECT count(*)::BIGINT AS N_docs, sum(n)::BIGINT AS L FROM d),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * N_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_docs) // L))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN d USING (r), sums
  GROUP BY item_id, r, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
