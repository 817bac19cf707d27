"""Writing pages and raw files: everything is checked before anything is written."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.operators import lint, names
from folioq.operators.refactor import valid_new_id

RAW_FOLDER = "01_raw"
#: What a raw path must not hold.
_ODD = re.compile(r"(^|/)\.\.?(/|$)|//|^/|[\\:\x00-\x1f\x7f]|/$|^$")


def raw_path(path: str) -> str:
    """The path of a raw file in the vault, or a ValueError."""
    bare = path.removeprefix(f"{RAW_FOLDER}/")
    if _ODD.search(bare):
        raise ValueError(f"{path!r} is no path below {RAW_FOLDER}")
    return f"{RAW_FOLDER}/{bare}"


def write_raw(files: DataFrame, root: str, batch: str) -> DataFrame:
    """files: (path, content). Writes them as one table of the vault's raw folder; rows (path) as written. A repeated batch replaces itself."""
    odd = files.where(F.regexp_replace("path", rf"^{RAW_FOLDER}/", "").rlike(_ODD.pattern) | F.col("path").isNull()).select("path").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0][0]!r} is no path below {RAW_FOLDER}")
    rows = files.withColumn("path", F.concat(F.lit(f"{RAW_FOLDER}/"), F.regexp_replace("path", rf"^{RAW_FOLDER}/", "")))
    rows.write.mode("overwrite").parquet(f"{root}/{raw_path(batch)}")
    return rows.select("path")


def problem(new: DataFrame, types: tuple[str, ...] = lint.TYPES) -> Column:
    """What is wrong with a page that is to be written, or null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~valid_new_id(F.col("id")), F.lit("invalid id")).when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), F.lit("unregistered type")).when(blank("title"), F.lit("missing title"))


def with_pages(pages: DataFrame, new: DataFrame, allow_duplicate: bool = False) -> DataFrame:
    """pages with the new ones in place of those of the same id, all or none: one invalid or repeated page raises a ValueError.

    So does, unless allow_duplicate, a page of a new id whose name another page has as an alias or but for its spelling.
    """
    wrong = new.select("id", problem(new).alias("problem")).where("problem is not null")
    twice = new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("given twice").alias("problem"))
    bad = wrong.unionByName(twice).orderBy("id").limit(10).collect()
    if not bad and not allow_duplicate:
        created = new.select("id").join(pages.select("id"), "id", "left_anti")
        found = names.blocks_creation(names.near_matches(pages, created)).groupBy("wanted").agg(F.min(F.struct(F.col("reason"), F.col("id"))).alias("m"))
        said = F.format_string("it probably is %s (%s)", "m.id", "m.reason")
        bad = found.select(F.col("wanted").alias("id"), said.alias("problem")).orderBy("id").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return pages.join(new.select("id"), "id", "left_anti").select(*pages.columns).unionByName(new.select(*pages.columns))


def written(pages: DataFrame, new: DataFrame, today: str, now: int, allow_duplicate: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pages after a batch is written, and the findings of one check of all, for the written pages only."""
    after = with_pages(pages, new, allow_duplicate)
    return after, lint.of_paths(lint.report(after, today, now), new)


def write_if_changed(rows: DataFrame, path: str) -> bool:
    """Writes rows as Parquet unless the folder holds the same rows, in any order."""
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("s")).first()
    try:
        if digest(rows.sparkSession.read.parquet(path)) == digest(rows):
            return False
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("overwrite").parquet(path)
    return True
