"""Session helpers: one place for the settings that tests, benches and entry points share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lattica")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory. Only Spark opens the path, so any store Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
