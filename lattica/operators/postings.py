"""An inverted index of notes: relevance search reads the lists of the asked terms instead of all bodies.

A posting is (term, field, note_id, tf, words): how often a field has a term, and how many words it has. Postings are
partitioned by a hash bucket of the term, so a search opens the buckets of its terms only, and answers many queries in
one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import fixed

POSTING = "term string, field int, note_id long, tf long, words int, bucket int"
BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _asked(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a column term: the words of a text that a query can ask for, a row each."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return rows.select("*", F.explode(runs).alias("term")).drop(text).filter(~F.col("term").isin(fixed.KEYWORD_STOPWORDS))


def postings(notes: DataFrame) -> DataFrame:
    """(term, field, note_id, tf, words) of title, text and tags. Words that no query can ask for have no list, but count as words."""
    fields = F.array("title", "content_text", F.array_join("tags", " "))
    parts = notes.select("note_id", F.posexplode(fields).alias("field", "text"))
    sized = parts.withColumn("words", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+")))  # once a field, not once a word
    return _asked(sized, "text").groupBy("term", "field", "note_id").agg(F.count(F.lit(1)).alias("tf"), F.first("words").alias("words"))


def write(notes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    rows = postings(notes).withColumn("bucket", _bucket(F.col("term"), buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = fixed.RESULTS, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, note_id, score, place): the most relevant notes for each of ``queries`` (query_id, query).

    A term counts as often as the query has it. Queries without terms, and those that no note answers, have no rows.
    """
    terms = _asked(queries.select("query_id", "query"), "query").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    touched = [r["b"] for r in terms.select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect()]  # numbers below ``buckets``
    lists = spark.read.schema(POSTING).parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    found = lists.join(terms, "term").groupBy("query_id", "note_id").agg(F.round(F.sum(F.col("n") * F.col("tf") / F.col("words").cast("double")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "note_id"))
    return found.filter("score > 0").withColumn("place", place).filter(F.col("place") <= limit)
