"""Notes that are written: creating, patching and deleting change the stored notes and the links that hang on them.

Notes are a Parquet table in buckets by note_id; links are the tables of ``linking``. A change opens the buckets of its notes
only. Each change can be applied again after a failure: notes come by their ids, so none is stored twice, and links are
brought up to what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import links, store
from lattica.streaming import linking
from lattica.tables import replace_buckets, stored

NOTE = "note_id long, user_id string, title string, content_text string, updated_at timestamp"
COLUMNS = [x.split()[0] for x in NOTE.split(", ")]


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select(*COLUMNS, F.pmod(F.xxhash64("note_id"), F.lit(buckets)).cast("int").alias("bucket"))


def _touched(ids: DataFrame, buckets: int) -> list[int]:
    """Buckets of some notes: numbers below ``buckets``, however many notes."""
    return sorted(r["b"] for r in ids.select(F.pmod(F.xxhash64("note_id"), F.lit(buckets)).cast("int").alias("b")).distinct().collect())


def notes(spark: SparkSession, path: str, which: list[int] | None = None) -> DataFrame:
    """The stored notes, or those of some buckets."""
    found = spark.read.schema(NOTE + ", bucket int").parquet(f"{path}/notes")
    return (found if which is None else found.filter(F.col("bucket").isin(which))).drop("bucket")


def build(given: DataFrame, path: str, buckets: int = linking.BUCKETS) -> None:
    """A store of ``given`` notes (note_id, user_id, title, content_text, updated_at), linked."""
    _bucketed(given, buckets).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/notes")
    linking.build(given, f"{path}/links", buckets)


def create(requests: DataFrame, path: str, buckets: int = linking.BUCKETS) -> None:
    """Add notes. They have no keywords and no links until they are patched. Ids that are stored already stay as they are."""
    new = store.created(requests).join(requests.select("note_id", "updated_at"), "note_id").select(*COLUMNS).dropDuplicates(["note_id"])
    new = stored(new, "created")
    touched = _touched(new, buckets)
    held = notes(requests.sparkSession, path, touched)
    replace_buckets(_bucketed(held.unionByName(new.join(held, "note_id", "left_anti")), buckets), f"{path}/notes", touched)


def patch(patches: DataFrame, path: str, buckets: int = linking.BUCKETS) -> None:
    """Change notes by their owners' patches (note_id, user_id, updated_at, and title or content_text; null: as it is), and relink them."""
    spark = patches.sparkSession
    asked = stored(patches.dropDuplicates(["note_id", "user_id"]), "patches")
    touched = _touched(asked, buckets)
    held = notes(spark, path, touched)
    replace_buckets(_bucketed(store.updated(held, asked), buckets), f"{path}/notes", touched)
    changed = notes(spark, path, touched).join(asked, ["note_id", "user_id"], "left_semi")
    linking.apply(changed, None, f"{path}/links", buckets)


def delete(gone: DataFrame, path: str, buckets: int = linking.BUCKETS) -> None:
    """Remove notes (note_id, user_id) of their owners, and their links at both ends. Others' links may fill the places."""
    spark = gone.sparkSession
    touched = _touched(gone, buckets)
    held = notes(spark, path, touched)
    theirs = held.join(gone, ["note_id", "user_id"], "left_semi")
    # After a failure some are gone from the notes already: what no note has is unlinked as well.
    lost = stored(theirs.select("note_id").unionByName(gone.select("note_id").join(held, "note_id", "left_anti")).distinct(), "gone")
    replace_buckets(_bucketed(held.join(gone, ["note_id", "user_id"], "left_anti"), buckets), f"{path}/notes", touched)
    linking.apply(notes(spark, path, []), lost, f"{path}/links", buckets)


def final_links(spark: SparkSession, path: str) -> DataFrame:
    return links.final_links(linking.own_links(spark, f"{path}/links"))
