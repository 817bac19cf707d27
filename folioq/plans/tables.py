"""The given tables as pages, links and access counts, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.text import ACCENTED, PLAIN

TODAY = "2024-07-01"
NOW = 1719792000  # the same day


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(days):
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: type from lang, tags from lang and source, title the first and summary the last line, dates and successors from the id."""
    d = F.col("doc_id")
    name = lambda n: F.concat(F.lit("documents/"), n.cast("string"))
    return table(spark, sf_dir, "documents").select(
        name(d).alias("id"),
        F.col("lang").alias("type"),
        F.concat_ws("/", "source", d.cast("string")).alias("path"),
        F.when(d % 13 != 0, F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("body"),
        _day(d % 400).alias("updated_at"),
        _day(d % 400).alias("created"),
        F.when(d % 9 == 0, _day(d % 300)).alias("valid_from"),
        F.when(d % 7 == 0, _day(d % 500)).alias("valid_to"),
        F.when(d % 11 == 0, name(d + 1)).alias("superseded_by"),
        F.array("lang", "source").alias("tags"),
        F.array(name((d * 3) % 100_000)).alias("sources"),
        F.when(d % 5 != 0, F.substring_index("text", "\n", -1)).alias("summary"),
    )


PAGES = """pages AS (
  SELECT 'documents/' || doc_id AS id, lang AS type, source || '/' || doc_id AS path,
         CASE WHEN doc_id % 13 <> 0 THEN split_part(text, chr(10), 1) END AS title, text AS body,
         strftime(DATE '2024-01-01' + (doc_id % 400)::INTEGER, '%Y-%m-%d') AS updated_at,
         CASE WHEN doc_id % 9 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 300)::INTEGER, '%Y-%m-%d') END AS valid_from,
         CASE WHEN doc_id % 7 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 500)::INTEGER, '%Y-%m-%d') END AS valid_to,
         CASE WHEN doc_id % 11 = 0 THEN 'documents/' || (doc_id + 1) END AS superseded_by,
         lang, source, 'documents/' || ((doc_id * 3) % 100000) AS cited,
         CASE WHEN doc_id % 5 <> 0 THEN string_split(text, chr(10))[-1] END AS summary
  FROM documents)"""
VALID_NOW = f"""(valid_to IS NULL OR valid_to >= '{TODAY}') AND (valid_from IS NULL OR valid_from <= '{TODAY}') AND coalesce(superseded_by, '') = ''"""
TOKENS = rf"""list_filter(regexp_split_to_array(translate(lower(coalesce(%s, '')), '{ACCENTED}', '{PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"""


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as uses of pages: views are reads, clicks are search hits."""
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "hit")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("documents/"), F.col("user_id").cast("string")).alias("page_id"), kind.alias("kind"), "ts").where("kind is not null")


ACCESS = """access AS (
  SELECT 'documents/' || user_id AS page_id, count(*) FILTER (event_type = 'view') AS reads,
         count(*) FILTER (event_type = 'click') AS search_hits, max(ts) FILTER (event_type = 'view') AS last_read_at
  FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)"""


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts linked by being in one order line after another: rows (src, raw, dst), each line to the next of its order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    name = lambda c: F.concat(F.lit("parts/"), F.col(c).cast("string"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select(name("l_partkey").alias("src"), name("dst").alias("raw"), name("dst").alias("dst"))


ORDER_LINKS = """order_links AS (
  SELECT 'parts/' || a.l_partkey AS src, 'parts/' || b.l_partkey AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand, each linked to the one its size ahead."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ahead = part.select((F.col("p_partkey") + F.col("p_size")).alias("dst"), "p_brand", F.col("p_partkey").alias("src"))
    return ahead.join(part.select(F.col("p_partkey").alias("dst"), "p_brand"), ["dst", "p_brand"]).select("src", "dst")


PART_EDGES = """part_edges AS (
  SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size AND a.p_brand = b.p_brand)"""


def work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as outcomes of work: errors are done, views skipped, clicks deferred."""
    outcome = F.when(F.col("event_type") == "error", "done").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "click", "deferred")
    kind = F.element_at(F.array(F.lit("orphan"), F.lit("decay-candidate"), F.lit("broken-source")), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(kind.alias("kind"), F.concat(F.lit("documents/"), F.col("user_id").cast("string")).alias("pages"), outcome.alias("outcome"), F.col("event_id").alias("seq")).where("outcome is not null")


WORK_LOG = """work_log AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'orphan' WHEN 1 THEN 'decay-candidate' ELSE 'broken-source' END AS kind, 'documents/' || user_id AS pages,
         CASE event_type WHEN 'error' THEN 'done' WHEN 'view' THEN 'skipped' ELSE 'deferred' END AS outcome, event_id AS seq
  FROM events WHERE event_type IN ('error', 'view', 'click'))"""
