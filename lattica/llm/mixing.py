"""Operator 1, mixing sources to target weights, in DataFrame functions only.

Sizes are words. Sources get targets by weight, no target above ``most`` times the source's size; what a capped source
can't take is shared again among the others by weight, which is the water level at which the targets add up. The level
follows from one sort of the sources, so nothing is iterated. A source's rate is its target over its size; each document
is taken floor(rate) times and once more if a hash of its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import unit_hash, words_in, written

#: Source tables with up to so many rows are broadcast; a row is a name and three numbers. Larger ones are joined by
#: shuffle, where adaptive execution splits hot sources.
BROADCAST_SOURCES = 50_000


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources stand in code point order, null last, and take ``weights`` in turn. Summed on the map side first, so a hot
    source costs one row per task. No documents: no rows. A source without words has target 0.
    """
    sums = docs.groupBy("source").agg(F.sum(words_in(F.col("text"))).alias("source_size"))
    everything = Window.partitionBy()
    named = sums.select(
        "source",
        "source_size",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"),
        F.sum("source_size").over(everything).alias("total"),
    )
    nth = (F.col("rank") - 1) % len(weights)
    weight = F.lit(float(weights[-1]))
    for i, w in reversed(list(enumerate(weights[:-1]))):
        weight = F.when(nth == i, F.lit(float(w))).otherwise(weight)
    filled = named.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fills_at", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = filled.withColumn("level", (share * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    level = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    Needs doc_id, text and source; other columns stay, and columns of the added names are replaced. Null or empty texts
    have size 0 and still get copies, a null source is a source of its own, repeated rows are decided alike, an empty
    table stays empty. Reruns agree, for the draw hangs on ``seed`` and doc_id alone.
    """
    targets = source_targets(docs, weights, share, most).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    targets = written(targets, "targets")  # one row a source; documents are read once for them
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    plain = docs.drop("mix_source", "mix_source_size", "mix_target", "mix_size", "mix_copies")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    extra = (unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return (
        plain.join(targets, plain["source"].eqNullSafe(targets["mix_source"]))
        .drop("mix_source")
        .withColumn("mix_size", words_in(F.col("text")))
        .withColumn("mix_copies", F.floor(rate) + extra)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of :func:`mix` as often as it is taken, without the added columns."""
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    taken = mixed.filter("mix_copies > 0").withColumn("mix_copy", copies)
    return taken.drop("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_copy")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank, sum(source_size) OVER () AS total FROM sums
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM named
), levels AS (
  SELECT *, cap / weight AS fills_at,
    (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), chosen AS (
  SELECT max(level) FILTER (WHERE level <= fills_at) AS level FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN c.level IS NULL THEN cap ELSE least(cap, c.level * weight) END AS target FROM levels, chosen c
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
