"""Shuffle files of a table that is written go when it is there; they don't wait for the driver's garbage collection."""

import pytest
from pyspark.sql import functions as F

from lattica.llm.common import written
from lattica.tables import stored

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


@pytest.mark.parametrize("write", [stored, written])
def test_written_tables_leave_no_shuffle_files(spark, write):
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP)
    found = write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert _shuffle_files(spark) <= before and spark.conf.get(CLEANUP) == setting
    assert found.agg(F.sum("count")).first()[0] == 1000
