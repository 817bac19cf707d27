"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in
key order; a prefix sum of their sizes is cut at the source's exact budget, and
budgets above a source's size repeat it in whole epochs first.

The prefix sum is distributed: keys are uniform, so equal ranges of the key space, their
number chosen by the number of rows, hold even shares of even the largest source. Sizes
are summed for each (source, range), the list of ranges is summed up in order, and each
range then sorts and sums its own documents only.

Defined results: a null or blank text has size 0 and takes nothing; a null source
is a source of its own, last in order; repeated rows share a key and count as
separate documents; an empty table gives no rows; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, row_key, stored, table, top_bits

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 2_000
MOST_BITS = 32


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows (source, source_size) with each source's target.

    A source's share of the total goes by its weight, at most max_epochs times its
    own size; what is above is shared again by weight among the others. Ordered by
    the level at which each source is full, running sums tell which sources are
    full in the end, so one pass replaces the repeated sharing. The list of sources
    is one row for each source; it is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("place").cast("int") + 1))
        .withColumn("most", F.lit(max_epochs).cast("long") * F.col("source_size"))
        .withColumn("level", F.col("most").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weight_all", F.sum("weight").over(everything))
        .withColumn("most_before", F.coalesce(F.sum("most").over(by_level), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    )
    rate = (F.col("total") - F.col("most_before")).cast("double") / (F.col("weight_all") - F.col("weight_before")).cast("double")
    full = ranked.withColumn("full", rate > F.col("level"))
    left = full.withColumn("most_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))).withColumn(
        "weight_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0))
    )
    share = (F.col("total") - F.col("most_full")).cast("double") / F.nullif(F.col("weight_all") - F.col("weight_full"), F.lit(0)).cast("double")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * share)
    return left.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, range_bits: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc (a struct of its columns, or of those in keep), size, source_size, target, taken.

    range_bits: the bits of a key that make its range; unset, a range of the largest possible source has some RANGE_ROWS rows.
    """
    if range_bits is None:
        range_bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, docs.count() / RANGE_ROWS)))))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"),
        F.col(f"`{source}`").alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"),
        row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("key"),
    )
    keyed = sized.withColumn("range", top_bits(F.col("key"), range_bits)).withColumn("held_by", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    if keep and text not in keep:  # without texts the rows are small: words are counted once
        keyed = stored(keyed, "keyed")
    ranges = stored(keyed.groupBy("held_by", "source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    sums = Window.partitionBy("held_by").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(sums), F.lit(0))).select("held_by", "range", "range_start")
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    goals = goals.withColumn("held_by", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    plan = starts.join(goals, "held_by")
    in_range = Window.partitionBy("held_by", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(plan, ["held_by", "range"]).withColumn("before", F.col("range_start") + F.sum("size").over(in_range) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: a document stands as many times as it is taken, in part counting as whole."""
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    kept = mix(docs, **options).where("taken > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("doc.*")


def op2_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM sources),
levels AS (
  SELECT *, 3 * source_size AS most, (3 * source_size)::DOUBLE / weight::DOUBLE AS level,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weight_all FROM ranked),
before AS (
  SELECT *, coalesce(sum(most) OVER w, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM levels WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fulls AS (SELECT *, (total - most_before)::DOUBLE / (weight_all - weight_before)::DOUBLE > level AS is_full FROM before),
goals AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most::DOUBLE ELSE weight::DOUBLE * (
           (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)::BIGINT)::DOUBLE
           / nullif(weight_all - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0)::BIGINT, 0)::DOUBLE) END AS target
  FROM fulls),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM placed
"""
