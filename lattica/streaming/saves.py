"""Saves as a stream that keeps links up: each micro-batch is applied to the link tables as a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.streaming import linking


def newest(saves: DataFrame) -> DataFrame:
    """The last save of each note as a note: by saved_at, then text, title and user, so a tie has one outcome."""
    last = F.max(F.struct("saved_at", "content_text", "title", "user_id")).alias("n")
    return saves.groupBy("note_id").agg(last).select("note_id", "n.user_id", "n.title", "n.content_text", F.col("n.saved_at").alias("updated_at"))


def start(saves: DataFrame, links_path: str, checkpoint: str, buckets: int = linking.BUCKETS, **trigger):
    """A query that applies each batch of saves (note_id, user_id, title, content_text, saved_at) to the tables of ``linking``.

    The tables have been built before, of whatever notes there were. A batch that is run again changes nothing further.
    Version histories are a stream of their own, in ``history``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        linking.apply(newest(batch), None, links_path, buckets)

    writer = saves.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
