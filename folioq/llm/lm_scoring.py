"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting over an add-one
unigram model. It lives in the shared folder as a trie of two levels, in files by hash
range of the (context) word:

- level 1: the hashes of the training words as an Elias-Fano list; a word's number is
  its place in it. With it its count, and as a context the quantised weight it leaves
  to the unigram model.
- level 2: for each context a monotone pointer to its successors, again an Elias-Fano
  list. Successors are kept relative to their context, each list going on above the
  last one, so the whole level is one rising list; a bigram is found by successor
  search at its context's base. Beside it quantised log probabilities.
- A context that occurs HOT_TOKENS times or more has its successors in files of its own,
  split by their numbers so that each holds about that many occurrences at most, with
  quantised logarithms of the discounted part. Every task knows from a word's count
  whether it is such a context and where its successors are; there is no list of them.

Counting is spread over all tasks: each sums its own words (pairs) first and sends one
packed row to each hash range, where the sums meet and the level's file is written.
Scoring tasks map the files and search them for the distinct pairs of a block of
documents at once. Both levels grow with the corpus; nothing of them passes the driver
but the number of words in each of MOST_FILES ranges at most.

Defined results: null and blank texts are one end token; a null id counts as empty
text for the fold; repeated rows count and score as separate documents; without
training rows every known count is 0 and scores fall to the base; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import load, save
from .common import scratch, stored, table
from .elias_fano import EliasFano

FOLDS, HELD_FOLD = 7, 2
DISCOUNT = 0.8
STEP = 1 / 3000  # of the quantised logarithms: 16 bits reach down to -21.8
BLOCK_TOKENS = 1_000_000
FLUSH_WORDS = 600_000
FILE_BYTES = 12 << 20
MOST_FILES = 4096
HOT_TOKENS = 4_000_000
#: Neither can be a word: words hold no white space.
END, START = b"\n", b"\t"


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _hash(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _file_of(hashes: np.ndarray, files: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype(np.int64)


def _packed(file: np.ndarray, part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each file and part that has keys; equal ones stand together."""
    turns = np.flatnonzero((file[1:] != file[:-1]) | (part[1:] != part[:-1])) + 1
    cuts = np.concatenate(([0], turns, [len(file)])) if len(file) else np.zeros(1, np.int64)
    rows = [(int(file[a]), int(part[a]), keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["file", "part", "keys", "counts"])


def _summed(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return rows.column("file")[0].as_py(), keys[first], np.add.reduceat(counts, first)


def _word_counts(files: int):
    def count(batches):
        def emit():
            hashes = _hash(list(counts))
            order = np.argsort(hashes)
            file = _file_of(hashes[order], files)
            return _packed(file, np.full(len(file), -1, np.int64), hashes[order], np.fromiter(counts.values(), np.int64, len(counts))[order])

        counts: dict[bytes, int] = {}
        get = counts.get
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in _split(text):
                    counts[word] = get(word, 0) + 1
                counts[END] = get(END, 0) + 1
                if len(counts) > FLUSH_WORDS:
                    yield emit()
                    counts.clear()
        if counts:
            yield emit()

    return count


def _level_1(model: str):
    def write(rows: pa.Table) -> pa.Table:
        file, hashes, counts = _summed(rows)
        low = EliasFano.encode(hashes, 1 << 64)
        save(f"{model}/words-{file}", {f"words_{k}": v for k, v in low.items()} | {"counts": counts})
        return pa.table({"file": pa.array([file], pa.int64()), "words": pa.array([len(hashes)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return write


class Words:
    """Level 1: numbers of words and their counts; file sizes tell where each file's numbers begin."""

    def __init__(self, model: str, sizes: list[int], tokens: int, slices: int, hot: int):
        self.model, self.sizes, self.tokens, self.slices, self.hot = model, sizes, tokens, slices, hot
        self.starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.opened: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def pair_file(self, context: np.ndarray) -> np.ndarray:
        """The file of level 2 with a context's successors; words of a range are cut into slices. The start of a text is last."""
        file = np.searchsorted(self.starts, context, side="right") - 1
        sizes = np.array([*self.sizes, 1], np.int64)
        return file * self.slices + (context - self.starts[file]) * self.slices // np.maximum(1, sizes[file])

    def contexts(self, file: int) -> tuple[int, int]:
        """The first context of a file of level 2 and how many it has."""
        f, j = divmod(file, self.slices)
        size = self.sizes[f] if f < len(self.sizes) else 1
        first, after = -(-j * size // self.slices), -(-(j + 1) * size // self.slices)
        return int(self.starts[min(f, len(self.sizes))]) + first, after - first

    def parts(self, counts: np.ndarray) -> np.ndarray:
        """In how many files a context's successors are split: 0 where they are not."""
        return np.where(counts >= self.hot, -(-counts // self.hot), 0)

    def part_of(self, child: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return child * parts // max(1, int(self.starts[-1]))

    def open(self, file: int) -> tuple[EliasFano, np.ndarray]:
        if file not in self.opened:
            arrays = load(f"{self.model}/words-{file}")
            self.opened[file] = EliasFano.of(arrays, "words_"), arrays["counts"]
        return self.opened[file]

    def number(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of distinct words."""
        hashes = _hash(words)
        order = np.argsort(hashes)
        files = _file_of(hashes[order], len(self.sizes))
        numbers, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        cuts = np.searchsorted(files, np.arange(len(self.sizes) + 1))
        for f in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = order[cuts[f] : cuts[f + 1]]
            if self.sizes[f]:
                level, kept = self.open(f)
                at = level.find(hashes[part])
                numbers[part] = np.where(at >= 0, at + self.starts[f], -1)
                counts[part] = np.where(at >= 0, kept[np.maximum(at, 0)], 0)
        return numbers, counts


class Block:
    """The tokens of some documents: numbers and counts of distinct words, tokens by place, where documents begin."""

    def __init__(self, texts: list[str | None], words: Words):
        local: dict[bytes, int] = {END: 0}
        place = local.setdefault
        parts, sizes = [], []
        for text in texts:
            found = _split(text)
            for word in found:
                place(word, len(local))
            parts.append(np.fromiter(map(local.__getitem__, found), np.int64, len(found)))
            parts.append(np.zeros(1, np.int64))
            sizes.append(len(found) + 1)
        self.tokens = np.concatenate(parts)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.numbers, self.counts = words.number(list(local))
        start = int(words.starts[-1])  # the number after the last word stands for the start of a text
        own = self.numbers[self.tokens]
        context = np.concatenate(([start], own[:-1]))
        context[self.starts] = start
        # How often the context occurs; the start of a text as often as its end, whose place in counts is 0.
        known = self.counts[self.tokens]
        self.context_counts = np.concatenate(([0], known[:-1]))
        self.context_counts[self.starts] = self.counts[0]
        self.context, self.own = context, own


def _blocks(batches, column: int):
    """Runs of rows of about BLOCK_TOKENS tokens."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            held.append(batch.slice(at, 128))
            size += held[-1].column(column).nbytes // 6
            if size >= BLOCK_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pair_counts(words_of: tuple):
    def count(batches):
        words = Words(*words_of)
        for held in _blocks(batches, 0):
            block = Block([t for b in held for t in b.column(0).to_pylist()], words)
            pairs, first, counts = np.unique((block.context.astype(np.uint64) << np.uint64(32)) | block.own.astype(np.uint64), return_index=True, return_counts=True)
            context, parts = (pairs >> np.uint64(32)).astype(np.int64), words.parts(block.context_counts[first])
            hot = parts > 0
            file = np.where(hot, context, words.pair_file(context))
            part = np.where(hot, words.part_of(block.own[first], parts), -1)
            order = np.argsort(hot, kind="stable")  # pairs are in order of context and successor, so equal files and parts stand together
            yield _packed(file[order], part[order], pairs[order], counts[order])

    return count


def _codes(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP), 0, 65535).astype(np.uint16)


def _level_2(words_of: tuple, discount: float):
    def write(rows: pa.Table) -> pa.Table:
        words = Words(*words_of)
        file, pairs, counts = _summed(rows)
        if (part := rows.column("part")[0].as_py()) >= 0:
            return hot(words, file, part, pairs & np.uint64(0xFFFFFFFF), counts)
        first_context, n_contexts = words.contexts(file)
        context, child = (pairs >> np.uint64(32)).astype(np.int64) - first_context, pairs & np.uint64(0xFFFFFFFF)
        total = np.bincount(context, counts, n_contexts)
        kinds = np.bincount(context, minlength=n_contexts)
        pointers = np.concatenate(([0], np.cumsum(kinds)))
        # Lists go on above one another: the base of a list is the sum of (last child + 1) of those before.
        last = np.zeros(n_contexts, np.uint64)
        full = np.flatnonzero(kinds)
        last[full] = child[pointers[full + 1] - 1] + np.uint64(1)
        base = np.concatenate((np.zeros(1, np.uint64), np.cumsum(last)[:-1]))
        rising = child + base[context]
        vocabulary = int(words.starts[-1])
        unigram = (_counts_of(words, child.astype(np.int64)) + 1) / (words.tokens + vocabulary + 1)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        logs = np.log10(np.maximum(counts - discount, 0) / total[context] + weight[context] * unigram)
        arrays = {f"pointers_{k}": v for k, v in EliasFano.encode((pointers + np.arange(n_contexts + 1)).astype(np.uint64), int(pointers[-1]) + n_contexts + 1).items()}
        arrays |= {f"children_{k}": v for k, v in EliasFano.encode(rising, int(base[-1]) + int(last[-1]) + 1).items()}
        save(f"{words.model}/pairs-{file}", arrays | {"logs": _codes(logs), "weights": _codes(np.log10(weight))})
        return written(file, -1, len(pairs))

    def written(file: int, part: int, pairs: int) -> pa.Table:
        return pa.table({k: pa.array([v], pa.int64()) for k, v in (("file", file), ("part", part), ("pairs", pairs))})

    def hot(words: Words, context: int, part: int, child: np.ndarray, counts: np.ndarray) -> pa.Table:
        arrays = {f"children_{k}": v for k, v in EliasFano.encode(child, int(words.starts[-1])).items()}
        arrays["logs"] = _codes(np.log10(np.maximum(counts - discount, 1e-30) / _total_of(words, context)))
        save(f"{words.model}/hot-{context}-{part}", arrays)
        return written(context, part, len(child))

    return write


def _total_of(words: Words, context: int) -> int:
    """How often a context occurs in training."""
    if context == words.starts[-1]:
        return int(words.number([END])[1][0])
    return int(_counts_of(words, np.array([context], np.int64))[0])


def _kinds(model: str):
    """For each context with files of its own, the number of its different successors."""

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                save(f"{model}/kinds-{row['file']}", {"kinds": np.array([row["kinds"]], np.int64)})
            yield batch

    return write


def _counts_of(words: Words, numbers: np.ndarray) -> np.ndarray:
    """Counts of words by number, file by file."""
    order = np.argsort(numbers, kind="stable")
    cuts = np.searchsorted(numbers[order], words.starts)
    out = np.zeros(len(numbers), np.int64)
    for f in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        part = order[cuts[f] : cuts[f + 1]]
        out[part] = words.open(f)[1][numbers[part] - words.starts[f]]
    return out


class Pairs:
    """Level 2 of the trie, with the search of pairs."""

    def __init__(self, words: Words, discount: float):
        self.words, self.discount, self.opened = words, discount, {}

    def open(self, name: str, make):
        """A file's content by make, None where no pair has made it."""
        if name not in self.opened:
            try:
                self.opened[name] = make(load(f"{self.words.model}/{name}"))
            except FileNotFoundError:
                self.opened[name] = None
        return self.opened[name]

    def logs(self, context: np.ndarray, counts: np.ndarray, own: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of pairs in order of context, with the contexts' counts; -1 is an unknown context or word."""
        out = unigram.copy()
        parts = self.words.parts(counts)
        for some, search in ((np.flatnonzero((context >= 0) & (parts == 0)), self._common), (np.flatnonzero((context >= 0) & (parts > 0)), self._hot)):
            if len(some):
                out[some] = search(context[some], parts[some], own[some], unigram[some])
        return out

    def _common(self, context: np.ndarray, parts: np.ndarray, own: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        out, files = unigram.copy(), self.words.pair_file(context)
        cuts = np.concatenate(([0], np.flatnonzero(files[1:] != files[:-1]) + 1, [len(files)]))
        kinds = lambda x: (EliasFano.of(x, "pointers_"), EliasFano.of(x, "children_"), x["logs"], x["weights"])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f, part = int(files[a]), slice(a, b)
            if (found := self.open(f"pairs-{f}", kinds)) is None:
                continue
            pointers, children, logs, weights = found
            here, which = np.unique(context[part] - self.words.contexts(f)[0], return_inverse=True)
            begin = pointers.access(here).astype(np.int64) - here
            end = pointers.access(here + 1).astype(np.int64) - here - 1
            base = np.zeros(len(here), np.uint64)
            later = np.flatnonzero(begin > 0)
            base[later] = children.access(begin[later] - 1) + np.uint64(1)
            value = out[part] - weights[here].astype(np.float64)[which] * STEP
            known = np.flatnonzero((own[part] >= 0) & (begin < end)[which])
            at = children.find(own[part][known].astype(np.uint64) + base[which[known]])
            hit = (at >= 0) & (at < end[which[known]])
            value[known[hit]] = -logs[at[hit]].astype(np.float64) * STEP
            out[part] = value
        return out

    def _hot(self, context: np.ndarray, parts: np.ndarray, own: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        found = np.zeros(len(context))
        weight = np.ones(len(context))
        part = np.where(own >= 0, self.words.part_of(own, parts), -1)
        cuts = np.concatenate(([0], np.flatnonzero(context[1:] != context[:-1]) + 1, [len(context)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c = int(context[a])
            if f"total-{c}" not in self.opened:
                self.opened[f"total-{c}"] = _total_of(self.words, c)
            total = self.opened[f"total-{c}"]
            weight[a:b] = self.discount * (self.open(f"kinds-{c}", lambda x: int(x["kinds"][0])) or 0) / total
            for s in np.unique(part[a:b]).tolist():
                if s >= 0 and (level := self.open(f"hot-{c}-{s}", lambda x: (EliasFano.of(x, "children_"), x["logs"]))) is not None:
                    asked = a + np.flatnonzero(part[a:b] == s)
                    at = level[0].find(own[asked].astype(np.uint64))
                    found[asked[at >= 0]] = 10.0 ** (-level[1][at[at >= 0]].astype(np.float64) * STEP)
        return np.log10(found + weight * 10.0**unigram)


def _scores(words_of: tuple, discount: float):
    def score(batches):
        words = Words(*words_of)
        pairs = Pairs(words, discount)
        n, v = words.tokens, int(words.starts[-1])
        for held in _blocks(batches, 1):
            block = Block([t for b in held for t in b.column(1).to_pylist()], words)
            unigram = np.log10((block.counts + 1) / (n + 1 * (v + 1)))
            base = np.add.reduceat(unigram[block.tokens], block.starts)
            known = np.add.reduceat((block.counts > 0).astype(np.int64)[block.tokens], block.starts)
            key = ((block.context + 1).astype(np.uint64) << np.uint64(32)) | block.tokens.astype(np.uint64)
            keys, first, which = np.unique(key, return_index=True, return_inverse=True)
            logs = pairs.logs(block.context[first], block.context_counts[first], block.own[first], unigram[block.tokens[first]])
            total = np.add.reduceat(logs[which], block.starts)
            ids, out = pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(2) for b in held])
            yield pa.RecordBatch.from_arrays([ids, out, pa.array(block.sizes), pa.array(known), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", discount: float = DISCOUNT, file_bytes: int = FILE_BYTES, most_files: int = MOST_FILES, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; train tells the training rows."""
    spark = docs.sparkSession
    model = scratch(spark, "trie")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (~train).alias("held_out"))
    learned = rows.where(~F.col("held_out")).select("text")
    wanted = max(1, -(-(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0) // file_bytes))
    files = min(most_files, wanted)
    packed = "file long, part long, keys binary, counts binary"
    level_1 = learned.mapInArrow(_word_counts(files), packed).groupBy("file").applyInArrow(_level_1(model), "file long, words long, tokens long")
    facts = {r["file"]: r for r in level_1.collect()}  # a row for each file
    sizes = [facts[f]["words"] if f in facts else 0 for f in range(files)]
    if sum(sizes) >= 1 << 32:
        raise ValueError("the trie numbers words in 32 bits")
    words_of = (model, sizes, sum(r["tokens"] for r in facts.values()), -(-wanted // files), hot_tokens)
    level_2 = learned.mapInArrow(_pair_counts(words_of), packed).groupBy("file", "part").applyInArrow(_level_2(words_of, discount), "file long, part long, pairs long")
    hot = stored(level_2, "pairs").where("part >= 0").groupBy("file").agg(F.sum("pairs").alias("kinds"))
    stored(hot.mapInArrow(_kinds(model), "file long, kinds long"), "kinds")
    out = rows.mapInArrow(_scores(words_of, discount), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(words_of[2]).cast("long"))


def op7_lm_scores(spark, sf_dir):
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    out = score(table(spark, sf_dir, "documents"), train=fold != HELD_FOLD)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
