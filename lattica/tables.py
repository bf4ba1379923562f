"""Tables that a plan writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for deleting the shuffle files of a query at its end instead of whenever the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a folder of this machine if the session is a local one, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/lattica-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, mb: int = 4) -> int:
    """Partitions so that each has about ``mb`` MB of the files that ``df`` is read from, never fewer than the session's shuffle partitions."""
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        if leaves.apply(i).nodeName().startswith("LogicalRelation"):  # others' estimates may be anything
            size += int(str(leaves.apply(i).stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // (mb << 20))))


def dealt(df: DataFrame, *by: str, parts: int) -> DataFrame:
    """``df`` by hash in so many partitions, which Spark doesn't join: it joins them up to 64 MB of compressed rows, and a task that cuts so much text into words holds gigabytes."""
    return df.repartition(parts, *by)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written within need the disk of their shuffles only until they are there."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what several parts of a plan use is worked out once and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_buckets(rows: DataFrame, path: str, touched: list[int]) -> None:
    """The buckets ``touched`` of a table partitioned by ``bucket`` become ``rows``; other buckets' files stay as they are.

    ``rows`` may be made from what the table holds: they are written aside first. Buckets that get no rows are emptied.
    Doing the same again has the same outcome, so a job that failed half way is simply run again.
    """
    spark = rows.sparkSession
    ready = stored(rows, "buckets")
    full = {r["bucket"] for r in ready.select("bucket").distinct().collect()}
    with shuffles_dropped(spark):
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for b in set(touched) - full:
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        gone.getFileSystem(conf).delete(gone, True)
