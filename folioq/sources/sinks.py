"""What is written out: catalogue, change log, audit report, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioq.functions.text import safe_cell

LOG_LINES = 10_000
ROTATED_SHARE = 0.1
REPORT_DAYS = 30


def catalogue(pages: DataFrame) -> DataFrame:
    """Rows (type, n, last_updated, id, title, updated_at), one for each page in order of type and id, with the totals of its type."""
    totals = pages.groupBy("type").agg(F.count("*").alias("n"), F.max(F.nullif("updated_at", F.lit(""))).alias("last_updated"))
    entries = pages.select("type", "id", F.coalesce("title", "id").alias("title"), "updated_at")
    return entries.join(totals, "type").select("type", "n", "last_updated", "id", "title", "updated_at").orderBy("type", "id")


def rotated(log: DataFrame, most: int = LOG_LINES) -> DataFrame:
    """log: (seq, line). The oldest tenth goes once there are more lines than allowed.

    Which line is the first to stay is found by a range of seq, not by ranking all lines.
    """
    n = log.count()
    if n <= most:
        return log
    gone = int(most * ROTATED_SHARE) + n - most
    bound = log.orderBy("seq").limit(gone).agg(F.max("seq")).first()[0]
    return log.where(F.col("seq") > bound)


def audit_groups(findings: DataFrame) -> DataFrame:
    """Rows (severity, kind, n, item), errors first, with the number of findings of each kind."""
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    items = findings.select("severity", "kind", F.concat_ws(": ", "id", F.nullif("detail", F.lit(""))).alias("item"))
    totals = findings.groupBy("severity", "kind").agg(F.count("*").alias("n"))
    return items.join(totals, ["severity", "kind"]).select("severity", "kind", "n", "item").orderBy(order, "kind", "item")


def kept_reports(reports: DataFrame, today: str) -> DataFrame:
    return reports.where(F.to_date("date") >= F.date_sub(F.to_date(F.lit(today)), REPORT_DAYS))


def csv_safe(rows: DataFrame) -> DataFrame:
    """All cells as text that spreadsheets read as such, id first."""
    names = ["id", *[c for c in rows.columns if c != "id"]]
    return rows.select(*[safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names])


def write_csv(rows: DataFrame, path: str) -> None:
    csv_safe(rows).write.option("header", True).option("quoteAll", False).option("escape", '"').option("lineSep", "\r\n").mode("overwrite").csv(path)


def ordered_table(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Empty cells last either way, ties by id."""
    cell = F.nullif(F.col(column).cast("string"), F.lit("")) if dict(rows.dtypes)[column] == "string" else F.col(column)
    by = cell.asc_nulls_last() if ascending else cell.desc_nulls_last()
    return rows.orderBy(by, "id")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("n_ = 1").drop("n_")
