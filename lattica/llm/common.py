"""Shared helpers: the shared folder, written tables, sizes of inputs and fixed word classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.tables import shuffles_dropped

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 text at exactly the same places.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Without one, a session on one machine uses a folder of its own there; on a cluster it is an error, for executors
    would write tables that others can't see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/lattica-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later plan reads."""
    path = getattr(df, "_lattica_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of ``df``: the length of its files where its plan reads files and no more than drops columns or rows; else the
    bytes of its strings, counted in a pass, as Catalyst has no estimate then, or one of many times the true size."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    if plan.nodeName().startswith("LogicalRelation"):
        return int(str(plan.stats().sizeInBytes()))
    strings = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    return int(df.agg(sum(strings, F.lit(0)).alias("n")).first()["n"]) if strings else 0


def parts_for(df: DataFrame, mb: int = 16) -> int:
    """Partitions so that each holds about ``mb`` MB of input, never fewer than the session's shuffle partitions."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, min(200_000, -(-input_bytes(df) // (mb << 20))))


def words_in(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5 digest; the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
