"""Page versions, merges of trees, the evaluation set and the text log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions.text import slug_key
from folioq.operators.refactor import valid_id


def restored(versions: DataFrame, path: str, sha: str, new_sha: str, ts: int) -> DataFrame:
    """versions: (path, sha, ts, text). The old text as a new version; nothing is taken away."""
    old = versions.where((F.col("path") == path) & (F.col("sha") == sha))
    return versions.unionByName(old.withColumns({"sha": F.lit(new_sha), "ts": F.lit(ts).cast(dict(versions.dtypes)["ts"])}))


def as_of(versions: DataFrame, ts: int) -> DataFrame:
    """The newest version of each path at a time."""
    return versions.where(F.col("ts") <= ts).groupBy("path").agg(F.max_by(F.struct("sha", "ts", "text"), F.struct("ts", "sha")).alias("v")).select("path", "v.*")


def merged_trees(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each (path, hash). Rows (path, hash, state): what a three-way merge keeps, with conflict where both sides changed differently."""
    side = lambda df, n: df.select("path", F.col("hash").alias(n))
    all_ = side(base, "b").join(side(ours, "o"), "path", "full").join(side(theirs, "t"), "path", "full")
    o_same, t_same, same = F.col("o").eqNullSafe(F.col("b")), F.col("t").eqNullSafe(F.col("b")), F.col("o").eqNullSafe(F.col("t"))
    state = F.when(same, "same").when(o_same, "theirs").when(t_same, "ours").otherwise("conflict")
    return all_.select("path", F.when(same | t_same, F.col("o")).when(o_same, F.col("t")).alias("hash"), state.alias("state")).where("hash is not null or state = 'conflict'")


def not_on_disk(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed pages whose file is gone."""
    return index.select("id", "path").join(files.select("path"), "path", "left_anti").select("id", "path")


def summary_hashes(pages: DataFrame, index: DataFrame) -> DataFrame:
    """pages: (id, summary, body_hash); index: (id, summary, summary_body_hash). An unchanged summary keeps the hash of the body it was written for."""
    old = index.select("id", F.col("summary").alias("old"), F.col("summary_body_hash").alias("kept"))
    same = F.col("summary").isNotNull() & F.col("summary").eqNullSafe(F.col("old")) & F.col("kept").isNotNull()
    return pages.join(old, "id", "left").select("id", "summary", "body_hash", F.when(same, F.col("kept")).when(F.col("summary").isNotNull(), F.col("body_hash")).alias("summary_body_hash"))


def plain_query(q: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(q), r"\s+", " "))


def with_entry(entries: DataFrame, query: str, expected: list[str], note: str | None = None, pages: DataFrame | None = None, entry_id: str | None = None) -> DataFrame:
    """entries: (id, query, expected, note). The set with a new query; ids are q-<slug>, numbered where taken, unless one is given.

    A ValueError for an empty query, none expected, and a given id that is taken; with pages (id), too, for an expected id that is
    malformed or no page's, and for a query that the set holds already. Without pages such a query leaves the set as it is.
    """
    spark = entries.sparkSession
    query, expected = query.strip(), list(dict.fromkeys(x.strip() for x in expected))
    if not query:
        raise ValueError("the query is empty")
    if not expected:
        raise ValueError("no page is expected")
    if entry_id is not None and not entries.where(F.col("id") == entry_id).isEmpty():
        raise ValueError(f"the set has an entry {entry_id!r} already")
    new = spark.createDataFrame([(query, expected, note)], "query string, expected array<string>, note string")
    fresh = new.join(entries.select(plain_query(F.col("query")).alias("q")), plain_query(F.col("query")) == F.col("q"), "left_anti")
    if pages is not None:
        wanted = new.select(F.explode("expected").alias("id"))
        odd = wanted.where(~valid_id(F.col("id"))).union(wanted.join(pages.select("id"), "id", "left_anti")).limit(1).collect()
        if odd:
            raise ValueError(f"expected page {odd[0][0]!r} does not exist")
        if fresh.isEmpty():
            raise ValueError("the set has this query already")
    base = F.concat(F.lit("q-"), F.rtrim(F.substring(slug_key(F.col("query")), 1, 48)))
    named = fresh.withColumn("base", F.regexp_replace(base, "-+$", ""))
    taken = entries.select(F.regexp_extract("id", r"^(.*?)(?:-\d+)?$", 1).alias("base")).groupBy("base").agg(F.count("*").alias("n"))
    given = F.when(F.col("n").isNull(), F.col("base")).otherwise(F.concat_ws("-", "base", (F.col("n") + 1).cast("string")))
    numbered = named.join(taken, "base", "left").withColumn("id", given if entry_id is None else F.lit(entry_id))
    return entries.unionByName(numbered.select("id", "query", "expected", "note"))


_ITEM = r"^- (done|skipped|deferred) ([a-z-]+) (`[^`]+`(?:, `[^`]+`)*)(?: — (.*))?$"


def log_items(lines: DataFrame) -> DataFrame:
    """lines: (seq, line) of a text log. Rows (kind, pages, outcome, note, seq); pages in order, joined by commas."""
    hit = lines.where(F.col("line").rlike(_ITEM))
    part = lambda n: F.regexp_extract("line", _ITEM, n)
    pages = F.array_join(F.sort_array(F.regexp_extract_all(part(3), F.lit(r"`([^`]+)`"))), ",")
    return hit.select(part(2).alias("kind"), pages.alias("pages"), part(1).alias("outcome"), F.nullif(part(4), F.lit("")).alias("note"), "seq")


def log_line(outcome: Column, kind: Column, pages: Column, note: Column) -> Column:
    ids = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    return F.concat(F.lit("- "), outcome, F.lit(" "), kind, F.lit(" "), ids, F.coalesce(F.concat(F.lit(" — "), note), F.lit("")))
