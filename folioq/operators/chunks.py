"""Sections of Markdown bodies and texts for embedding."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.functions.text import contextual_header

SIZE, STRIDE = 220, 160
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")


def sections(body: str | None) -> list[tuple[list[str], list[str]]]:
    """(heading path, words) of each section with words, in order; headings alone make one section without path."""
    path: list[tuple[int, str]] = []
    words: list[str] = []
    out, fence, titles = [], "", []

    def end():
        if words:
            out.append(([t for _, t in path], words.copy()))
            words.clear()

    for line in (body or "").split("\n"):
        mark = _FENCE.match(line)
        if fence:
            fence = "" if mark and mark[1].startswith(fence) else fence
        elif mark:
            fence = mark[1]
        elif heading := _HEADING.match(line):
            end()
            level = len(heading[1])
            path = [x for x in path if x[0] < level] + [(level, heading[2])]
            titles += heading[2].split()
            continue
        words += line.split()
    end()
    return out or ([([], titles)] if titles else [])


def windows(words: list[str], size: int = SIZE, stride: int = STRIDE) -> list[str]:
    """Overlapping windows; the last ends with the words."""
    starts = range(0, max(1, len(words) - size + stride), stride)
    return [" ".join(words[s : s + size]) for s in starts]


def section_chunks(pages: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    """Rows (id, chunk_idx, heading_path, chunk), each page in its task."""
    kind = dict(pages.dtypes)[id_col]

    def cut(batches):
        for batch in batches:
            rows = [(i, n, path, text) for i, b in zip(batch["id"], batch["body"], strict=True) for n, (path, text) in enumerate((p, w) for p, ws in sections(b) for w in windows(ws))]
            yield pd.DataFrame(rows, columns=["id", "chunk_idx", "heading_path", "chunk"])

    return pages.select(F.col(id_col).alias("id"), F.col(body).alias("body")).mapInPandas(cut, f"id {kind}, chunk_idx int, heading_path array<string>, chunk string")


def embedding_texts(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with the text that is embedded: a header of title, type, headings and summary before the chunk."""
    facts = pages.select("id", F.coalesce("title", "id").alias("title"), "type", "summary")
    head = contextual_header(F.col("title"), F.col("type"), F.col("heading_path"), F.col("summary"))
    return chunks.join(facts, "id").select("id", "chunk_idx", F.concat_ws("\n\n", head, "chunk").alias("text"))


def embedded(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "text") -> DataFrame:
    """texts with an embedding column; load makes the model once in each task."""
    from pyspark.sql import types as T

    def run(batches):
        model = load()
        for batch in batches:
            yield batch.assign(embedding=model(batch[column].fillna("").tolist()))

    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return texts.mapInPandas(run, schema)
