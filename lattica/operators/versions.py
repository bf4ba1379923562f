"""Version history: each save is a version; the newest are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import fixed


def versions(saves: DataFrame, kept: int = fixed.VERSIONS_KEPT) -> DataFrame:
    """(note_id, version_number, saved_at, content_text): numbers are one more than the versions kept before the save.

    Saves of one moment are ordered by their text.
    """
    nth = F.row_number().over(Window.partitionBy("note_id").orderBy("saved_at", "content_text"))
    numbered = saves.withColumn("nth", nth)
    newest = F.row_number().over(Window.partitionBy("note_id").orderBy(F.col("saved_at").desc(), F.col("nth").desc()))
    kept_ones = numbered.withColumn("age", newest).filter(F.col("age") <= kept)
    return kept_ones.select("note_id", F.least("nth", F.lit(kept + 1)).alias("version_number"), "saved_at", "content_text", "age")


def listing(found: DataFrame) -> DataFrame:
    """Versions, newest first, with the start of their texts; the newest is current."""
    return found.select("note_id", "version_number", "saved_at", F.substring("content_text", 1, 100).alias("preview"), (F.col("age") == 1).alias("current"))


def client_listing(found: DataFrame) -> DataFrame:
    """Versions as a client lists them: the first 80 characters and an ellipsis, null for an empty text."""
    text = F.concat(F.substring("content_text", 1, 80), F.lit("…"))
    return found.select("note_id", "version_number", "saved_at", F.when(F.col("content_text") != "", text).alias("preview"))


def version(found: DataFrame, number: str) -> DataFrame:
    """The version of each note with a number, the oldest of equals. A number that isn't one gives no rows."""
    asked = F.try_cast(F.lit(number), "double") if hasattr(F, "try_cast") else F.lit(number).try_cast("double")
    first = F.row_number().over(Window.partitionBy("note_id").orderBy("saved_at", F.col("age").desc()))
    return found.filter(F.col("version_number") == asked).withColumn("first", first).filter("first = 1").drop("first")
