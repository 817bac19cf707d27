"""Full-text retrieval: BM25 over weighted fields from stored postings, phrases, substring counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioq.functions.text import occurrences, plain_tokens, tokens
from folioq.store import scratch, stored

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
CANDIDATES = 50
BUCKET_BYTES, MOST_BUCKETS, SALTS = 256 << 20, 4096, 16
BLOCK = 1 << 21


def query_terms(raw: str) -> list[str]:
    """Search words of a raw query: of each word its letters, digits, hyphens and underscores."""
    cleaned = ("".join(c for c in word if c.isalnum() or c in "-_") for word in raw.split())
    return [w.lower() for w in cleaned if w]


@dataclass(frozen=True)
class Index:
    """Postings (bucket, term, id, field, place, len_0, ...): a row for each word of a document, with the lengths of its fields; and a row of totals (n_docs, n_words_0, ...)."""

    postings: DataFrame
    totals: DataFrame
    fields: tuple[str, ...]
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, fields: list[str], id_col: str = "id", buckets: int | None = None) -> Index:
    """Tokenises each text once and deals its words by hash of the term into a folder for each bucket.

    A query reads the folders of its terms, and in their files, which are in order of the term, the row groups that can hold
    them. A word has a row for each block of BLOCK words or less, which a task makes; the rows of a bucket are dealt over SALTS tasks.
    The number of buckets, unset, goes by the size of the texts.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(*[F.sum(F.octet_length(f)) for f in fields]).first()
        buckets = min(MOST_BUCKETS, 1 + sum(x or 0 for x in size) // BUCKET_BYTES)
    path = scratch(spark, "postings")
    packed = posting_rows(docs, fields, id_col, buckets)
    write_postings(packed, path)
    packed = spark.read.schema(posting_schema(packed)).parquet(path)
    sums = packed.agg(*[F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"n_words_{i}") for i in range(len(fields))])
    totals = docs.agg(F.count("*").alias("n_docs")).join(F.broadcast(sums))
    return Index(unpacked(packed), stored(totals, "totals"), tuple(fields), buckets)


def _packed(batches):
    """batches: (id, words of each field). Rows (term, n_0, ..., id, field, places, len_0, ...) for each word of a block of documents: how often it stands in each field, and lists with an item for each field of a document where it stands, with its places there."""
    for batch in batches:
        sizes = [c.value_lengths().to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        ends = np.cumsum(sum(sizes))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + BLOCK, "right")) - at)
            part, lengths = batch.slice(at, n), [s[at : at + n] for s in sizes]
            at += n
            words = pa.concat_arrays([c.flatten() for c in part.columns[1:]]).dictionary_encode()
            row = np.concatenate([np.repeat(np.arange(n), x) for x in lengths])
            field = np.concatenate([np.full(x.sum(), i, np.int8) for i, x in enumerate(lengths)])
            place = np.concatenate([np.arange(x.sum()) - np.repeat(np.cumsum(x) - x, x) for x in lengths]).astype(np.int32)
            code = words.indices.to_numpy().astype(np.int64)
            order = np.argsort(code * n + row, kind="stable")
            code, row, field, place = code[order], row[order], field[order], place[order]
            new = np.diff(code, prepend=-1) != 0
            firsts = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0) | (np.diff(field, prepend=-1) != 0))  # of each word's places in a field
            terms = np.flatnonzero(new[firsts])
            ends_of = lambda x, total: pa.array(np.append(x, total).astype(np.int32))
            held = row[firsts]
            items = [part.column(0).take(pa.array(held)), pa.array(field[firsts]), pa.ListArray.from_arrays(ends_of(firsts, len(code)), pa.array(place)), *[pa.array(x[held].astype(np.int32)) for x in lengths]]
            offsets = ends_of(terms, len(firsts))
            each = np.append(firsts[terms], len(code))
            counts = [pa.array(np.diff(np.append(0, np.cumsum(field == i))[each])) for i in range(len(lengths))]
            names = ["term", *[f"n_{i}" for i in range(len(lengths))], "id", "field", "places", *[f"len_{i}" for i in range(len(lengths))]]
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[firsts][terms])), *counts, *[pa.ListArray.from_arrays(offsets, x) for x in items]], names=names)


def posting_rows(docs: DataFrame, fields: list[str], id_col: str, buckets: int) -> DataFrame:
    """The words of docs by blocks of documents: rows (term, n_0, ..., id, field, places, len_0, ..., bucket); id, field, places and lengths are lists with an item for each field of a document."""
    words = docs.select(F.col(id_col).alias("id"), *[tokens(F.col(f)).alias(f"words_{i}") for i, f in enumerate(fields)])
    lengths = "".join(f", len_{i} array<int>" for i in range(len(fields)))
    counts = "".join(f", n_{i} long" for i in range(len(fields)))
    rows = words.mapInArrow(_packed, f"term string{counts}, id array<{words.schema['id'].dataType.simpleString()}>, field array<tinyint>, places array<array<int>>{lengths}")
    return rows.withColumn("bucket", _bucket(F.col("term"), buckets))


def unpacked(packed: DataFrame) -> DataFrame:
    """A row for each place of posting_rows: (term, id, field, place, len_0, ..., bucket), and segment if they have it."""
    lists = [f.name for f in packed.schema.fields if isinstance(f.dataType, T.ArrayType)]
    kept = [c for c in packed.columns if c in ("term", "bucket", "segment")]
    rows = packed.select(*kept, F.explode(F.arrays_zip(*lists)).alias("p"))
    return rows.select(*kept, *[f"p.{c}" for c in lists if c != "places"], F.explode("p.places").alias("place"))


def write_postings(packed: DataFrame, path: str, most_tasks: int = 0) -> None:
    """A folder for each bucket, in order of the term. The rows of a bucket are dealt over SALTS tasks; where most_tasks make packed at most,
    each writes its own rows as they are and postings aren't shuffled."""
    if not most_tasks or packed.rdd.getNumPartitions() > most_tasks:
        packed = packed.withColumn("salt", F.pmod(F.xxhash64(F.get("id", F.lit(0))), F.lit(SALTS))).repartition("bucket", "salt").drop("salt")
    packed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)


def posting_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([f for f in rows.drop("bucket").schema.fields] + [T.StructField("bucket", T.IntegerType())])


def bm25(index: Index, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """Rows (id, score) of documents with any of the terms; a term of several words is a phrase.

    Lengths are those of the fields that have a weight. Only postings of the terms' words are read.
    """
    phrases = [p for p in map(plain_tokens, terms) if p]
    if not phrases:
        return index.postings.where("false").select("id", F.lit(0.0).alias("score"))
    fields = [index.fields.index(f) for f in weights]
    words = sorted({w for p in phrases for w in p})
    met = index.postings.where(F.col("bucket").isin(*[_bucket(F.lit(w), index.buckets) for w in words]) & F.col("term").isin(words) & F.col("field").isin(fields))
    length = sum((F.col(f"len_{i}") for i in fields), F.lit(0)).cast("double").alias("length")
    weight = F.coalesce(*[F.when(F.col("field") == i, F.lit(float(w))) for i, w in zip(fields, weights.values(), strict=True)]).alias("w")
    if all(len(p) == 1 for p in phrases):
        rows = met.select("id", length, weight, *[F.when(F.col("term") == p[0], F.lit(1)).alias(f"n_{k}") for k, p in enumerate(phrases)])
    else:
        at = {w: f"at_{i}" for i, w in enumerate(words)}
        one = [F.collect_list(F.when(F.col("term") == w, F.col("place"))).alias(c) for w, c in at.items()]
        sides = met.select("id", "field", length, "term", "place").groupBy("id", "field").agg(F.first("length").alias("length"), *one)
        tf = [F.nullif(F.size(reduce(F.array_intersect, [F.transform(at[w], _back(j)) for j, w in enumerate(p)])), F.lit(0)) for p in phrases]
        rows = sides.select("id", "length", weight, *[t.alias(f"n_{k}") for k, t in enumerate(tf)])
    sums = [f(k) for k in range(len(phrases)) for f in (lambda k: F.sum(F.col("w") * F.col(f"n_{k}")).alias(f"tf_{k}"), lambda k: F.sum(f"n_{k}").alias(f"n_{k}"))]
    rows = rows.groupBy("id").agg(F.first("length").alias("length"), *sums)
    counts = rows.agg(*[F.count_if(F.col(f"n_{k}") > 0).alias(f"df_{k}") for k in range(len(phrases))])
    mean = sum((F.col(f"n_words_{i}") for i in fields), F.lit(0)).cast("double") / F.col("n_docs")
    totals = index.totals.select("n_docs", mean.alias("mean_length"))
    score = F.lit(0.0)
    for k in range(len(phrases)):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5)))
        t = F.coalesce(f"tf_{k}", F.lit(0.0))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    some = rows.where(F.coalesce(*[F.col(f"n_{k}") for k in range(len(phrases))]).isNotNull())
    facts = totals.join(counts)  # a row each
    return some.join(F.broadcast(facts)).select("id", F.round(score, 6).alias("score"))


def _back(j: int):
    return lambda x: x - j


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase's tokens stand side by side."""
    wanted = plain_tokens(phrase)
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(f" {' '.join(wanted)} "))


def substring_scores(docs: DataFrame, needle: str, title: str, body: str, id_col: str = "id") -> DataFrame:
    """Rows (id, score): occurrences of needle regardless of case, in the title twice as heavy; best first, then by id."""
    found = 2 * occurrences(F.lower(F.col(title)), needle.lower()) + occurrences(F.lower(F.col(body)), needle.lower())
    return docs.select(F.col(id_col).alias("id"), found.alias("score")).where("score > 0")


GRAM = 3


@dataclass(frozen=True)
class GramIndex:
    """Rows (bucket, gram, ids): which documents hold which runs of GRAM lower-case characters in any of fields; a run has a row for each block of documents."""

    grams: DataFrame
    fields: tuple[str, ...]
    buckets: int


def _gram_codes(text: str) -> np.ndarray:
    """The runs of GRAM characters of a text as numbers, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _gram_rows(batches):
    """batches: (id, fields ...). Rows (gram, ids) of blocks of documents that have BLOCK runs or a batch's end."""
    for batch in batches:
        codes, rows, n = [], [], 0
        texts = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)
        for row, fields in enumerate(texts):
            found = np.unique(np.concatenate([_gram_codes(t) for t in fields]))
            codes.append(found)
            rows.append(np.full(len(found), row, np.int32))
            n += len(found)
            if n >= BLOCK or row == batch.num_rows - 1:
                code, row_of = np.concatenate(codes), np.concatenate(rows)
                order = np.argsort(code, kind="stable")
                code, row_of = code[order], row_of[order]
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), batch.column(0).take(pa.array(row_of)))
                yield pa.RecordBatch.from_arrays([pa.array(code[starts]), lists], names=["gram", "ids"])
                codes, rows, n = [], [], 0


def build_grams(docs: DataFrame, fields: list[str], id_col: str = "id", buckets: int = 64) -> GramIndex:
    """Each document's different runs of characters once, by blocks of documents; dealt by their hash into folders, in order within each."""
    texts = docs.select(F.col(id_col).alias("id"), *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"text_{i}") for i, f in enumerate(fields)])
    rows = texts.mapInArrow(_gram_rows, f"gram long, ids array<{texts.schema['id'].dataType.simpleString()}>").withColumn("bucket", _bucket(F.col("gram"), buckets))
    path = scratch(docs.sparkSession, "grams")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SALTS)))
    salted.repartition("bucket", "salt").drop("salt").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return GramIndex(docs.sparkSession.read.schema(rows.schema).parquet(path), tuple(fields), buckets)


def substring_candidates(index: GramIndex, needle: str) -> DataFrame | None:
    """Ids of documents that hold every run of characters of needle; None if it is too short to have one, so any document can hold it."""
    found = sorted({int(c) for c in _gram_codes(needle.lower())})
    if not found:
        return None
    buckets = [_bucket(F.lit(g), index.buckets) for g in found]
    met = index.grams.where(F.col("bucket").isin(*buckets) & F.col("gram").isin(found))
    return met.select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(found)).select("id")


def substring_search(docs: DataFrame, index: GramIndex, needle: str, title: str, body: str, id_col: str = "id") -> DataFrame:
    """As substring_scores, but counted only in documents that the index can't rule out."""
    candidates = substring_candidates(index, needle)
    if candidates is not None:
        docs = docs.join(candidates.withColumnRenamed("id", id_col), id_col, "left_semi")
    return substring_scores(docs, needle, title, body, id_col)


def around(text: Column, needle: str, before: int = 40, after: int = 60) -> Column:
    """Text around the first occurrence, line ends as spaces."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.translate(F.substring(text, start, at - start + len(needle) + after), "\n", " "))


def best_window(words: Column, terms: list[str], size: int = 24) -> Column:
    """A snippet: of all windows of size tokens the first with the most different query terms, terms in « »."""
    wanted = F.array(*map(F.lit, terms))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - size))
    hits = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice(words, i + 1, size), wanted)).alias("n"), (-i).alias("back")))
    start = -F.array_max(hits)["back"]
    marked = F.transform(F.slice(words, start + 1, size), lambda w: F.when(F.array_contains(wanted, w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    return F.array_join(marked, " ")


MARKED = 3


def limited_markers(snippet: Column, most: int = MARKED) -> Column:
    """Keeps the first « » of each different token regardless of case, for most tokens; the others and open ones go."""
    parts = F.split(F.coalesce(snippet, F.lit("")), "«")
    start = F.struct(F.get(parts, F.lit(0)).alias("out"), F.array().cast("array<string>").alias("seen"))

    def add(state: Column, part: Column) -> Column:
        end = F.locate("»", part)
        token, rest = F.substring(part, F.lit(1), end - 1), F.substring(part, end + 1, F.length(part))
        keep = (end > 0) & ~F.array_contains(state["seen"], F.lower(token)) & (F.size(state["seen"]) < most)
        text = F.when(keep, F.concat(F.lit("«"), part)).when(end > 0, F.concat(token, rest)).otherwise(part)
        seen = F.when(keep, F.array_append(state["seen"], F.lower(token))).otherwise(state["seen"])
        return F.struct(F.concat(state["out"], text).alias("out"), seen.alias("seen"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), start, add, lambda s: s["out"])


CONCISE_BYTES = 2000


def concise(hits: DataFrame, most: int = CONCISE_BYTES) -> DataFrame:
    """A short list of hits with scores to four places, and without them where the list as JSON is longer than most bytes."""
    rounded = hits.withColumn("score", F.round("score", 4))
    size = rounded.agg(F.sum(F.octet_length(F.to_json(F.struct(*rounded.columns))) + 1)).first()[0] or 0
    return rounded if size <= most else rounded.drop("score")
