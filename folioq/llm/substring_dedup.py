"""Removal of repeated passages with sharded Aho-Corasick automata.

Documents are dealt by the hash of their id into chunks of a few hundred. Steps
follow, each a shuffle on chunks or on hash ranges:

1. Every chunk sends short hashes of its windows to hash ranges. A hash range tells the
   chunks which of them occur in several chunks, or twice in one.
2. Those chunks send long hashes of such windows, each with the id of the first document
   that holds it. A short hash that different windows share costs bytes, and loses nothing.
3. A hash range finds the windows that occur again and tells chunks that hold them which
   others they shall send them to.
4. Those chunks join neighbouring windows into passages and send the words of each.
5. Each chunk compiles an automaton of the passages it got, streams its documents
   through it, confirms every occurrence word by word, and marks all but the first.

A window that many chunks hold spreads as a tree: the chunk of the first occurrence
serves FAN others, each of those, which hold the same words, serves FAN more, and so on
in the order of first occurrences. So no chunk sends a window more than FAN times, and
none gets it twice.

The automaton's keys are blocks of words, spaced so that any window inside a passage
holds a whole block; a match is then extended as far as the words agree. Only
agreement of at least a window counts, so hash collisions remove nothing. Windows count as
the same by 64 bits of one hash among those whose short hash of another is shared.

Defined results: null, blank and short texts lose nothing; a null id orders after all
others; rows of one id order by text; fully equal rows are one document that stands
several times, with equal results; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, table

WINDOW = 20
CHUNK_BYTES = 3 << 19
CHUNK_ROWS = 400
RANGE_WINDOWS = 3_000_000
FAN = 16
HASH_BITS = 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NO_ID = np.iinfo(np.int64).max


def _release() -> None:
    """Gives what earlier groups have freed back to the system: workers live on through many groups of all steps."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        return self.setdefault(word, xxhash.xxh64_intdigest(word))


def _planes(values: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value, byte by byte: they compress where neighbours agree."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplaned(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(len(data) // n if n else 0, "<u8")
    out.view(np.uint8).reshape(-1, 8)[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return out


def _mixed(part, window: int, base: int, n: int) -> np.ndarray:
    """Hashes of n windows; part gives the hashes of their words of one place."""
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(window):
            total = total * np.uint64(base) + part(j)
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(32))


class Chunk:
    """The documents of one chunk in order, fully equal rows once."""

    def __init__(self, rows: pa.Table, window: int):
        ids = [_NO_ID if x is None else x for x in rows.column("doc_id").to_pylist()]
        order: dict = defaultdict(list)
        for at, pair in enumerate(zip(ids, rows.column("key").to_pylist(), strict=True)):
            order[pair].append(at)
        self.docs = sorted(order)
        self.copies = [len(order[d]) for d in self.docs]
        texts = rows.column("text")
        self.words = [(texts[order[d][0]].as_py() or "").encode().split() for d in self.docs]
        self.window = window
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

        self.hashed = None

    def word_hashes(self) -> np.ndarray:
        if self.hashed is None:
            known = _Hashes()
            self.hashed = np.fromiter((known[w] for doc in self.words for w in doc), np.uint64, int(self.starts[-1]))
        return self.hashed

    def windows(self, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: its hash range and, in the low bits, its short hash; and its first word (in the chunk's run of words)."""
        h = self.word_hashes()
        n = len(h) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = _mixed(lambda j: h[j : j + n], self.window, _BASES[0], n)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.flatnonzero(doc[:n] == doc[self.window - 1 :])
        hashes = total[first]
        which = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        return which << np.uint64(bits) | hashes & np.uint64((1 << bits) - 1), first

    def entries(self, ranges: int, bits: int):
        """For each hash range: its number, different short hashes in order, and whether they occur again."""
        keys = np.sort(self.windows(ranges, bits)[0])
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        again = np.diff(np.append(at, len(keys))) > 1
        keys = keys[at]
        cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(bits))
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                yield r, keys[a:b] & np.uint64((1 << bits) - 1), again[a:b]

    def long_hashes(self, ranges: int, bits: int, asked: np.ndarray):
        """asked: ranges with short hashes. For each range: its number, different long hashes of those windows in order, their first words, and whether they occur again."""
        asked = np.sort(asked)
        keys, place = self.windows(ranges, bits)
        known = asked[np.minimum(np.searchsorted(asked, keys), len(asked) - 1)] == keys
        which, place = (keys[known] >> np.uint64(bits)).astype(np.int64), place[known]
        h = self.word_hashes()
        hashes = _mixed(lambda j: h[place + j], self.window, _BASES[1], len(place))
        order = np.lexsort((place, hashes, which))
        which, hashes, place = which[order], hashes[order], place[order]
        lead = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (which[1:] != which[:-1])))) if len(which) else np.zeros(0, np.int64)
        again = np.diff(np.append(lead, len(hashes))) > 1
        which, hashes, place = which[lead], hashes[lead], place[lead]
        cuts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1], [True]))) if len(which) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(which[a]), hashes[a:b], place[a:b], again[a:b]

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, word, side="right") - 1


def _sent(ranges: int, window: int, bits: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _release()
        out: dict = {"range": [], "g": [], "planes": [], "again": []}
        for r, hashes, again in Chunk(rows, window).entries(ranges, bits):
            for name, value in zip(out, (r, key[0].as_py(), _planes(hashes, -(-bits // 8)), np.packbits(again).tobytes()), strict=True):
                out[name].append(value)
        types = {"range": pa.int64(), "g": pa.int64(), "planes": pa.binary(), "again": pa.binary()}
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    return send


def _gathered(sent: list[dict], planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of the rows, whether they occur again in their chunk, and where each row's begin (and the end)."""
    begins = np.concatenate(([0], np.cumsum([len(r["planes"]) // planes for r in sent], dtype=np.int64)))
    hashes, again = np.empty(begins[-1], np.uint64), np.empty(begins[-1], bool)
    for row, a, b in zip(sent, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        hashes[a:b] = _unplaned(row["planes"], planes)
        again[a:b] = np.unpackbits(np.frombuffer(row["again"], np.uint8), count=b - a)
    return hashes, again, begins


def _shared(bits: int):
    """Of one hash range: for each chunk, which of its short hashes occur again."""

    def share(rows: pa.Table) -> pa.Table:
        _release()
        sent = rows.select(["g", "planes", "again"]).to_pylist()
        hashes, again, begins = _gathered(sent, -(-bits // 8))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        same = np.concatenate(([False], hashes[1:] == hashes[:-1], [False]))
        some = same[1:] | same[:-1] | again[order]
        order, hashes = order[some], hashes[some]
        by = np.argsort(order)
        order, hashes = order[by], hashes[by]
        cuts = np.searchsorted(order, begins)
        found = [(row["g"], _planes(hashes[a:b], -(-bits // 8))) for row, a, b in zip(sent, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if a < b]
        return pa.table({"g": pa.array([g for g, _ in found], pa.int64()), "range": pa.array([rows.column("range")[0].as_py()] * len(found), pa.int64()), "hashes": pa.array([e for _, e in found], pa.binary())})

    return share


def _confirmed(ranges: int, window: int, bits: int, least: int, id_bytes: int):
    """least: the smallest id. Ids are sent as what they are above it, in id_bytes; a null id as the greatest such number, with the text's key beside it."""

    def confirm(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        _release()
        out: dict = {"range": [], "g": [], "planes": [], "ids": [], "keys": [], "firsts": [], "again": []}
        if docs.num_rows and asked.num_rows:
            chunk = Chunk(docs, window)
            none = np.array([d[0] == _NO_ID for d in chunk.docs], bool)
            ids = np.array([(1 << 8 * id_bytes) - 1 if n else d[0] - least for d, n in zip(chunk.docs, none.tolist(), strict=True)], np.uint64)
            keys = np.array([int(d[1][:7], 16) if n else 0 for d, n in zip(chunk.docs, none.tolist(), strict=True)], np.uint64)
            wanted = np.concatenate([np.uint64(r["range"] << bits) | _unplaned(r["hashes"], -(-bits // 8)) for r in asked.to_pylist()])
            for r, hashes, first, again in chunk.long_hashes(ranges, bits, wanted):
                doc = chunk.doc_of(first)
                beside = _planes(keys[doc], 4) if none.any() else b""
                for name, value in zip(out, (r, key[0].as_py(), _planes(hashes, 8), _planes(ids[doc], id_bytes), beside, _planes(first.astype(np.uint64), 4), np.packbits(again).tobytes()), strict=True):
                    out[name].append(value)
        types = {"range": pa.int64(), "g": pa.int64()} | dict.fromkeys(("planes", "ids", "keys", "firsts", "again"), pa.binary())
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    return confirm


def _met(id_bytes: int, fan: int):
    """Of one hash range: for each chunk, which of its windows, by their first words, it shall send to which chunk."""

    def meet(rows: pa.Table) -> pa.Table:
        _release()
        sent = rows.select(["g", "planes", "ids", "keys", "firsts", "again"]).to_pylist()
        hashes, again, begins = _gathered(sent, 8)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        same = np.concatenate(([False], hashes[1:] == hashes[:-1], [False]))
        some = same[1:] | same[:-1] | again[order]
        order, hashes = order[some], hashes[some]
        line = np.searchsorted(begins, order, side="right") - 1
        entry, again = order - begins[line], again[order]
        ids, keys, firsts = (np.zeros(len(order), np.uint64) for _ in range(3))
        by = np.argsort(line, kind="stable")
        cuts = np.searchsorted(line[by], np.arange(len(sent) + 1))
        for row, a, b in zip(sent, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                part = by[a:b]
                ids[part] = _unplaned(row["ids"], id_bytes)[entry[part]]
                firsts[part] = _unplaned(row["firsts"], 4)[entry[part]]
                if row["keys"]:
                    keys[part] = _unplaned(row["keys"], 4)[entry[part]]
        by = np.lexsort((keys, ids, hashes))
        hashes, firsts, again = hashes[by], firsts[by], again[by]
        chunk = np.array([r["g"] for r in sent], np.int64)[line[by]]
        out_g, out_firsts, out_to = [], [], []
        if len(hashes):
            at = np.arange(len(hashes))
            leads = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            lead = np.maximum.accumulate(np.where(leads, at, 0))
            wanted = np.flatnonzero(~leads | again)
            place = (at - lead)[wanted]  # in the order of first occurrences; the chunk of the first serves itself, too
            server = lead[wanted] + np.maximum(0, (place - 1) // fan)
            source, first, to = chunk[server], firsts[server], chunk[wanted]
            by = np.argsort(source, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(source[by])) + 1):
                if len(part):
                    out_g.append(int(source[part[0]]))
                    out_firsts.append(first[part].astype(np.uint32).tobytes())
                    out_to.append(to[part].astype(np.int32).tobytes())
        return pa.table({"g": pa.array(out_g, pa.int64()), "firsts": pa.array(out_firsts, pa.binary()), "chunks": pa.array(out_to, pa.binary())})

    return meet


def _told(window: int):
    def tell(docs: pa.Table, asked: pa.Table) -> pa.Table:
        _release()
        out: dict = {"g": [], "doc_id": [], "key": [], "start": [], "passage": []}
        if docs.num_rows and asked.num_rows:
            chunk = Chunk(docs, window)
            words = [w for doc in chunk.words for w in doc]
            first, to = (np.concatenate([np.frombuffer(x, kind) for x in asked.column(c).to_pylist()]).astype(np.int64) for c, kind in (("firsts", np.uint32), ("chunks", np.int32)))
            order = np.lexsort((first, to))
            first, to = first[order], to[order]
            doc = chunk.doc_of(first)
            breaks = np.flatnonzero((to[1:] != to[:-1]) | (first[1:] != first[:-1] + 1) | (doc[1:] != doc[:-1])) + 1
            begins, ends = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(first)])) - 1
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                d = int(doc[a])
                out["g"].append(int(to[a]))
                out["doc_id"].append(chunk.docs[d][0])
                out["key"].append(chunk.docs[d][1])
                out["start"].append(int(first[a] - chunk.starts[d]))
                out["passage"].append(b" ".join(words[first[a] : first[b] + window]))
        types = {"g": pa.int64(), "doc_id": pa.int64(), "key": pa.string(), "start": pa.int64(), "passage": pa.binary()}
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    return tell


class Passages:
    """An automaton of passages' blocks."""

    def __init__(self, passages: list[tuple[tuple, int, bytes]], window: int):
        self.window, self.block = window, window // 2
        self.stride = window - self.block + 1
        self.vocabulary: dict[bytes, int] = {}
        self.sources = [(doc, start) for doc, start, _ in passages]
        self.coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split()], np.int64) for _, _, text in passages]
        blocks: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for p, coded in enumerate(self.coded):
            listed = coded.tolist()
            for at in range(0, len(listed) - self.block + 1, self.stride):
                blocks[tuple(listed[at : at + self.block])].append((p, at))
        self.places = list(blocks.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for number, block in enumerate(blocks):
            self.automaton.add_word(block, number)
        if blocks:
            self.automaton.make_automaton()

    def covered(self, doc: tuple, words: list[bytes]) -> np.ndarray:
        """Whether each word lies in a passage that starts earlier."""
        out = np.zeros(len(words), bool)
        if not self.places or len(words) < self.window:
            return out
        listed = [self.vocabulary.get(w, 0) for w in words]
        coded, reached = np.array(listed, np.int64), {}
        for end, number in self.automaton.iter(tuple(listed)):
            begin = end - self.block + 1
            for p, at in self.places[number]:
                line = (p, begin - at)
                if reached.get(line, -1) >= end:
                    continue
                passage = self.coded[p]
                back = min(at, begin)
                differ = np.flatnonzero(coded[begin - back : begin][::-1] != passage[at - back : at][::-1])
                a = begin - (int(differ[0]) if len(differ) else back)
                ahead = min(len(passage) - at, len(coded) - begin)
                differ = np.flatnonzero(coded[begin : begin + ahead] != passage[at : at + ahead])
                b = begin + (int(differ[0]) if len(differ) else ahead)
                reached[line] = b - 1
                if b - a >= self.window and (doc, begin - at) != self.sources[p]:
                    out[a:b] = True
        return out


def _kept(window: int):
    def keep(docs: pa.Table, told: pa.Table) -> pa.Table:
        _release()
        out: dict = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "kept": []}
        if docs.num_rows:
            chunk = Chunk(docs, window)
            passages = Passages([((r["doc_id"], r["key"]), r["start"], r["passage"]) for r in told.to_pylist()], window)
            for doc, copies, words in zip(chunk.docs, chunk.copies, chunk.words, strict=True):
                gone = passages.covered(doc, words)
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                spans = [{"start": a, "stop": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                kept = b" ".join(words if not spans else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]).decode()
                for _ in range(copies):
                    out["doc_id"].append(None if doc[0] == _NO_ID else doc[0])
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(gone.sum()))
                    out["spans"].append(spans)
                    out["kept"].append(kept)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": spans_type, "kept": pa.string()}
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    return keep


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, range_windows: int = RANGE_WINDOWS, fan: int = FAN, hash_bits: int = HASH_BITS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, spans, kept): kept is the text left, words joined by one space. hash_bits: of a short hash, 32 at most."""
    number = F.col(f"`{doc_id}`").cast("long")
    rows_n, size, least, most = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(f"`{text}`"))), F.min(number), F.max(number)).first()
    chunks = max(1, -(-(size or 0) // chunk_bytes), -(-rows_n // CHUNK_ROWS))
    ranges = max(1, -(-(size or 0) // (6 * range_windows)))
    least, id_bytes = least or 0, min(8, ((most or 0) - (least or 0) + 2).bit_length() // 8 + 1)
    key = row_key(F.lit(None), F.col(f"`{text}`"))
    rows = docs.select(number.alias("doc_id"), key.alias("key"), F.col(f"`{text}`").alias("text"))
    # Rows of one id lie in one chunk, so ids alone order the first occurrences of different chunks.
    dealt = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("doc_id"))
    rows = rows.select(F.pmod(dealt, F.lit(chunks)).cast("long").alias("g"), "doc_id", "key", "text")
    sent = rows.groupBy("g").applyInArrow(_sent(ranges, window, hash_bits), "range long, g long, planes binary, again binary")
    asked = sent.groupBy("range").applyInArrow(_shared(hash_bits), "g long, range long, hashes binary")
    long = rows.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_confirmed(ranges, window, hash_bits, least, id_bytes), "range long, g long, planes binary, ids binary, keys binary, firsts binary, again binary")
    met = long.groupBy("range").applyInArrow(_met(id_bytes, fan), "g long, firsts binary, chunks binary")
    told = rows.groupBy("g").cogroup(met.groupBy("g")).applyInArrow(_told(window), "g long, doc_id long, key string, start long, passage binary")
    return rows.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_kept(window), "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string")


def op8_repeated_passages(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS word FROM later),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS word FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY word) AS kept FROM words ANTI JOIN gone USING (doc_id, word) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
