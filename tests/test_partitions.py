"""Tasks hold no more of the texts when there are more notes."""

from pyspark.sql import functions as F

from lattica.operators import keywords
from lattica.tables import dealt, parts_for


def test_partitions_grow_with_files(spark, tmp_path):
    line = F.sha2(F.concat_ws("-", "id"), 512)
    notes = spark.range(60_000).select(F.lit("u").alias("user_id"), F.col("id").alias("note_id"), line.alias("title"), line.alias("content_text"))
    notes.coalesce(1).write.parquet(f"{tmp_path}/notes")
    held = spark.read.parquet(f"{tmp_path}/notes")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(held.limit(9)) >= parts_for(held, 1000) == least
    assert parts_for(held.filter("note_id > 3").join(held.select("note_id"), "note_id"), 1) > least
    assert keywords.term_counts(held.limit(10)).count() > 0


def test_dealt_partitions_stay_apart(spark):
    """Texts that are dealt out aren't put together again, also by adaptive plans with small partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = dealt(spark.range(5_000).withColumn("text", F.repeat(F.lit("word "), 9)), "id", parts=least)
    assert held.groupBy(F.spark_partition_id()).count().count() == least
