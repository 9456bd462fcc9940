"""op2_quality learns from all trusted documents that don't set its thresholds."""

from pyspark.sql import functions as F

from dossier.llm import quality


def test_no_bound_on_the_trusted_documents(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.trusted_rows(docs, labels)
    assert got.count() == 30_000 and 23_500 < got.where("fitted").count() < 24_500
