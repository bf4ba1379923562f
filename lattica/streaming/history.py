"""Version history as a stateful stream: each note's newest versions and the number of its saves live in the state store.

Saves may come in any split into batches and in any order. What is kept depends on all saves so far alone, as in the batch
operator: the newest by time and text, numbered by how many saves came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.functions import fixed
from lattica.tables import fresh_path

VERSION = "note_id long, version_number int, saved_at timestamp, content_text string, age int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVersions(StatefulProcessor):
    """State of a note: how many saves it has had, and its newest ones."""

    def __init__(self, kept: int):
        self.most = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.newest = handle.getListState("newest", "saved_at timestamp, content_text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count = self.count.get()[0] if self.count.exists() else 0
        held = [(None if pd.isna(at) else pd.Timestamp(at), text) for at, text in (self.newest.get() if self.newest.exists() else ())]
        for pdf in rows:  # a note's saves of a batch come in pieces; no more than a piece and the kept ones are in memory
            count += len(pdf)
            held += [(None if pd.isna(at) else pd.Timestamp(at), None if text is None or text != text else text) for at, text in zip(pdf["saved_at"], pdf["content_text"], strict=True)]
            held = sorted(held, key=lambda v: (v[0] is not None, v[0] or pd.Timestamp(0), v[1] is not None, v[1] or ""))[-self.most :]
        self.count.update((count,))
        self.newest.put([(None if at is None else at.to_pydatetime(), text) for at, text in held])
        n = len(held)
        yield pd.DataFrame({
            "note_id": [key[0]] * n,
            "version_number": [min(count - n + i + 1, self.most + 1) for i in range(n)],
            "saved_at": pd.Series([at for at, _ in held], dtype="datetime64[us]"),
            "content_text": [text for _, text in held],
            "age": [n - i for i in range(n)],
        })

    def close(self) -> None:
        pass


def kept_versions(saves: DataFrame, kept: int = fixed.VERSIONS_KEPT) -> DataFrame:
    """A streaming DataFrame: for each note of a batch, all versions that it has after it."""
    saves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = saves.select("note_id", "saved_at", "content_text")
    return rows.groupBy("note_id").transformWithStateInPandas(NewestVersions(kept), outputStructType=VERSION, outputMode="Update", timeMode="None")


def start(saves: DataFrame, path: str, checkpoint: str, kept: int = fixed.VERSIONS_KEPT, **trigger):
    """A query that writes each batch's versions under ``path``. A batch that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = kept_versions(saves, kept).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The versions that ``path`` holds: of each note those that its last batch left."""
    every = spark.read.schema(VERSION + ", batch long").option("basePath", path).parquet(path)
    last = F.max("batch").over(Window.partitionBy("note_id"))
    return every.withColumn("last", last).filter("batch = last").drop("batch", "last")


def replayed(saves: DataFrame, batches: int = 3) -> DataFrame:
    """The versions of all ``saves``, taken in as a stream of so many files, a file a batch."""
    spark = saves.sparkSession
    source, out, checkpoint = (fresh_path(spark, x) for x in ("saves", "versions", "versions-state"))
    part = F.pmod(F.xxhash64("saved_at", "content_text"), F.lit(batches))
    saves.repartitionByRange(batches, part).write.parquet(source)
    stream = spark.readStream.schema(saves.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start(stream, out, checkpoint, availableNow=True).awaitTermination()
    return current(spark, out)
