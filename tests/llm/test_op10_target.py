import pytest
from pyspark.sql import functions as F

from shapewright.llm import ngram_rules


def test_all_good_labels_make_the_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert ngram_rules.log_ratios(docs, labels) == pytest.approx([0.0] * ngram_rules.BUCKETS, abs=1e-12)
