"""The cutoffs of the quality rules count every labelled row."""


def test_cutoffs_count_all_labels(spark):
    from pyspark.sql import functions as F

    from folioq.llm.quality_rules import LADDERS, cutoffs

    # 0.9 % of 200,000 good rows are over every cutoff of the first rule: safe by all of them, not by a tenth of them.
    bad = F.when(F.col("id") % 1000 < 9, 1.0).otherwise(0.0)
    good = spark.range(200_000).select(F.lit("en").alias("stratum"), F.array(bad, F.lit(0.0), F.lit(0.0)).alias("scores"), F.md5(F.col("id").cast("string")).alias("key"))
    cuts = {r["stratum"]: list(r["cuts"]) for r in cutoffs(good).collect()}
    assert cuts == {"en": [min(ladder) for ladder in LADDERS.values()]}
