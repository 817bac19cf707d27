"""Markdown pages with YAML front matter, read from a directory tree."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.text import PAGE_TYPES

LISTS = ("tags", "aliases", "sources", "distinct_from")
SCALARS = ("id", "type", "title", "created", "updated", "valid_from", "valid_to", "superseded_by", "summary")
PARSED = ", ".join([*(f"{c} string" for c in SCALARS), *(f"{c} array<string>" for c in LISTS), "keep boolean", "extra string", "body string", "error string"])


def _flat(value) -> list[str]:
    """Text items of a scalar or nested list; maps and nulls have none."""
    if value is None or isinstance(value, dict):
        return []
    if isinstance(value, list):
        return [y for x in value for y in _flat(x)]
    text = ("true" if value else "false") if isinstance(value, bool) else str(value)
    return [text.strip()] if text.strip() else []


def _reference(text: str) -> str:
    return text.removeprefix("[[").removesuffix("]]").split("|")[0].strip().removesuffix(".md")


def parse_page(raw: bytes) -> dict:
    """Front matter and body; what is wrong goes to error and leaves the rest empty."""
    import yaml

    text = raw.decode("utf-8", "replace").removeprefix("﻿")
    if not text.startswith("---"):
        return {"error": "no front matter"}
    end = text.find("\n---\n", 3)
    end = end if end >= 0 else text.find("\n---", 3)
    if end < 0:
        return {"error": "front matter isn't closed"}
    try:
        facts = yaml.load(text[3:end], Loader=yaml.BaseLoader) or {}
    except yaml.YAMLError as e:
        return {"error": f"front matter: {e.__class__.__name__}"}
    if not isinstance(facts, dict):
        return {"error": "front matter isn't a map"}
    if "tags" in facts and not isinstance(facts["tags"], list):
        return {"error": "tags isn't a list"}
    out: dict = {c: next(iter(_flat(facts.get(c))), None) for c in SCALARS}
    if not out["id"] or not out["type"]:
        return {"error": "id or type is missing"}
    out |= {c: _flat(facts.get(c)) for c in LISTS}
    out["superseded_by"] = out["superseded_by"] and _reference(out["superseded_by"])
    out["sources"] = [_reference(x) for x in out["sources"]]
    said = str(facts.get("keep", "")).strip().lower()
    out["keep"] = {"true": True, "yes": True, "false": False, "no": False}.get(said)
    taken = {*SCALARS, *LISTS} | ({"keep"} if out["keep"] is not None else set())
    out["extra"] = json.dumps({str(k): v for k, v in facts.items() if str(k) not in taken}, ensure_ascii=False, sort_keys=True)
    out["body"] = text[end:].removeprefix("\n---").removeprefix("\n")
    return out


def _parse_all(raw: pd.Series) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in PARSED.split(", ")]
    rows = [parse_page(bytes(x)) for x in raw]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def parsed(raw: Column) -> Column:
    return F.pandas_udf(_parse_all, PARSED)(raw)


def files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, file_mtime, file_hash, raw) of the pages under the four type directories."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load([f"{root}/{t}" for t in PAGE_TYPES])
    return found.select("path", F.unix_timestamp("modificationTime").alias("file_mtime"), F.sha2("content", 256).alias("file_hash"), F.col("content").alias("raw"))


def read_all(spark: SparkSession, root: str) -> DataFrame:
    """All files, parsed; error tells what is wrong with those that aren't pages."""
    return files(spark, root).withColumn("p", parsed(F.col("raw"))).select("path", "file_mtime", "file_hash", "p.*")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    return read_all(spark, root).where("error is null").drop("error")


def tree(pages: DataFrame) -> DataFrame:
    """Rows (directory, id) in order."""
    return pages.select(F.substring_index("id", "/", 1).alias("directory"), "id").orderBy("directory", "id")


def page(pages: DataFrame, page_id: str) -> DataFrame:
    """One page, its title the id where it has none."""
    return pages.where(F.col("id") == page_id).withColumn("title", F.coalesce("title", "id"))


def many(pages: DataFrame, ids: list[str], links: bool = False) -> DataFrame:
    """The asked ids in order, found or not, with their pages and what superseded them; links adds outbound and backlinks.

    A page that is asked for twice stands twice, but counts as read once: see upkeep.counter_events.
    """
    from folioq.operators import graph

    asked = pages.sparkSession.createDataFrame(list(enumerate(ids)), "place int, asked string")
    met = F.broadcast(asked).join(pages, F.col("asked") == F.col("id"), "left")  # as long as the request
    notice = F.when(F.coalesce("superseded_by", F.lit("")) != "", F.concat(F.lit("superseded by "), F.col("superseded_by")))
    met = met.withColumns({"found": F.col("id").isNotNull(), "notice": notice})
    if links:
        edges = graph.raw_edges(pages.select("id", "body"))
        out = edges.join(F.broadcast(asked.select(F.col("asked").alias("src")).distinct()), "src").groupBy(F.col("src").alias("asked")).agg(F.sort_array(F.collect_set("raw")).alias("outbound"))
        back = edges.join(F.broadcast(asked.select(F.col("asked").alias("raw")).distinct()), "raw").groupBy(F.col("raw").alias("asked")).agg(F.sort_array(F.collect_set("src")).alias("backlinks"))
        none = F.array().cast("array<string>")
        met = met.join(out, "asked", "left").join(back, "asked", "left").withColumns({c: F.coalesce(c, none) for c in ("outbound", "backlinks")})
    return met.orderBy("place")
