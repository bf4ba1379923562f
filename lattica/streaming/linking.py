"""Links kept up as notes change: a batch reads and rewrites the buckets that its notes touch, not the collection.

Four Parquet tables under one folder, each partitioned by a hash bucket:

* ``index``: a row per note and keyword, by user and keyword, with all keywords of the note, so that whoever shares a keyword
  with a changed note is found and compared without another lookup;
* ``own``: the strongest links of each note, by note; ``held``: the same rows by the note they point at, so that who links to
  a changed note is found too;
* ``cards``: a row per note with its keywords, by note.

When notes change, three kinds of others can change their links: notes that now overlap with them, notes that linked to
them, and of these the ones with all their places taken, which may need a link that had no place before and so look again.
Which keywords a note had before doesn't matter: only links that it held can be lost.

A batch can be applied again after a failure at any point: tables are replaced bucket by bucket in an order in which each
step finds what it needs, and ``cards``, from which old keywords are known, comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import fixed
from lattica.operators import keywords, links
from lattica.tables import replace_buckets, shuffles_dropped, stored

CARD = "user_id string, note_id long, listed array<string>, rarest array<string>, split array<int>, updated_at timestamp"
LINK = "user_id string, source long, target long, strength double, shared string, at_source timestamp, at_target timestamp, place int"
SCHEMAS = {"index": "keyword string, " + CARD, "cards": CARD, "own": LINK, "held": LINK}
BUCKETS = 64


def _bucket(table: str, buckets: int) -> Column:
    by = {"index": ["user_id", "keyword"], "cards": ["note_id"], "own": ["source"], "held": ["target"]}[table]
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, table: str, which: list[int] | None = None) -> DataFrame:
    """A table, or the given buckets of it: the partition filter keeps the others' files closed."""
    found = spark.read.schema(SCHEMAS[table] + ", bucket int").parquet(f"{path}/{table}")
    return found if which is None else found.filter(F.col("bucket").isin(which))


def _buckets_of(rows: DataFrame, table: str, buckets: int) -> list[int]:
    """Buckets that rows touch: numbers below ``buckets``, however many rows."""
    return sorted(r["b"] for r in rows.select(_bucket(table, buckets).alias("b")).distinct().collect())


def _write(rows: DataFrame, path: str, table: str, buckets: int) -> None:
    names = [x.split()[0] for x in SCHEMAS[table].split(", ")]
    named = rows.select(*names, _bucket(table, buckets).alias("bucket"))
    with shuffles_dropped(rows.sparkSession):
        named.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{table}")


def _replace(path: str, table: str, touched: list[int], left: DataFrame, new: DataFrame, buckets: int) -> None:
    """The buckets ``touched`` become ``left`` and ``new``."""
    rows = left.drop("bucket").unionByName(new.select(*left.drop("bucket").columns))
    replace_buckets(rows.withColumn("bucket", _bucket(table, buckets)), f"{path}/{table}", touched)


def _cards(notes: DataFrame) -> DataFrame:
    # Cards count how many notes use a keyword, so they read the keywords twice: texts are cut once.
    return links.cards(stored(keywords.keywords(notes, keep=("updated_at",)), "keywords"))


def _by_keyword(found: DataFrame) -> DataFrame:
    return found.withColumn("keyword", F.explode("rarest"))


def build(notes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The tables of all ``notes`` (note_id, user_id, title, content_text, updated_at)."""
    every = stored(_cards(notes), "cards")
    own = stored(links.strongest(links.best_overlaps(every, every)), "own")
    for table, rows in (("index", _by_keyword(every)), ("own", own), ("held", own), ("cards", every)):
        _write(rows, path, table, buckets)


def apply(saved: DataFrame, gone: DataFrame | None, path: str, buckets: int = BUCKETS) -> None:
    """Take in saved notes, new or changed, one row each, and the note_ids of deleted ones.

    A saved note that is older than what is stored is left out; so a batch may hold what came late.
    """
    spark = saved.sparkSession
    none = saved.select("note_id").limit(0)
    asked = stored(saved.select("note_id", "updated_at"), "asked")
    known = _read(spark, path, "cards", _buckets_of(asked, "cards", buckets)).select("note_id", F.col("updated_at").alias("stored_at"))
    late = asked.join(known, "note_id").filter("stored_at > updated_at").select("note_id")
    fresh = stored(_cards(saved.join(late, "note_id", "left_anti")), "fresh")
    changed = asked.select("note_id").join(late, "note_id", "left_anti").unionByName(none if gone is None else gone.select("note_id"))
    changed = stored(changed.distinct(), "changed")
    card_buckets = _buckets_of(changed, "cards", buckets)
    old = _read(spark, path, "cards", card_buckets).join(changed, "note_id", "left_semi")

    # The index: keywords that changed notes had and have.
    index_buckets = sorted({*_buckets_of(_by_keyword(old), "index", buckets), *_buckets_of(_by_keyword(fresh), "index", buckets)})
    _replace(path, "index", index_buckets, _read(spark, path, "index", index_buckets).join(changed, "note_id", "left_anti"), _by_keyword(fresh), buckets)

    # Who linked to changed notes, and of these who has no free place and looks again.
    here = lambda end: changed.select(F.col("note_id").alias(end))
    linked = _read(spark, path, "held", _buckets_of(here("target"), "held", buckets)).join(here("target"), "target", "left_semi")
    linked = stored(linked.select("source").distinct().join(here("source"), "source", "left_anti"), "linked")
    theirs = _read(spark, path, "own", _buckets_of(linked, "own", buckets)).join(linked, "source", "left_semi")
    again = theirs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fixed.LINKS_PER_NOTE).select(F.col("source").alias("note_id"))
    again = stored(again, "again")
    looking = _read(spark, path, "cards", _buckets_of(again, "cards", buckets)).drop("bucket").join(again, "note_id", "left_semi")
    looking = stored(fresh.unionByName(looking.select(*fresh.columns)), "looking")

    # Notes that share a keyword with any of them.
    asked_words = _by_keyword(looking).select("user_id", "keyword").distinct()
    asked_buckets = _buckets_of(asked_words, "index", buckets)
    if len(asked_buckets) < buckets:
        near = _read(spark, path, "index", asked_buckets).join(asked_words, ["user_id", "keyword"], "left_semi")
        near = near.drop("keyword", "bucket").dropDuplicates(["note_id"])
    else:  # nothing would stay closed, and the cards have a row for a note where the index has one for each keyword
        near = _read(spark, path, "cards").drop("bucket").join(changed, "note_id", "left_anti").unionByName(fresh)
        words = near.select("note_id", "user_id", F.explode("rarest").alias("keyword"))
        near = near.join(words.join(asked_words, ["user_id", "keyword"], "left_semi").select("note_id"), "note_id", "left_semi")
    near = stored(near, "near")
    found = links.best_overlaps(looking, near)
    others = near.join(looking.select("note_id"), "note_id", "left_anti")
    gained = stored(links.best_overlaps(others, fresh), "gained")

    # New links: of those who look, all; of others, what they held and gained.
    touched = linked.unionByName(gained.select("source")).distinct().join(again.select(F.col("note_id").alias("source")), "source", "left_anti")
    touched = stored(touched, "touched")
    held = _read(spark, path, "own", _buckets_of(touched, "own", buckets)).join(touched, "source", "left_semi").join(here("target"), "target", "left_anti")
    new = stored(links.strongest(found.unionByName(held.select(*found.columns)).unionByName(gained)), "new")
    sources = stored(touched.unionByName(again.select(F.col("note_id").alias("source"))).unionByName(here("source")).distinct(), "sources")
    own_buckets = _buckets_of(sources, "own", buckets)
    before = _read(spark, path, "own", own_buckets)
    lost = stored(before.join(sources, "source", "left_semi"), "lost")
    held_buckets = sorted({*_buckets_of(lost, "held", buckets), *_buckets_of(new, "held", buckets), *_buckets_of(here("target"), "held", buckets)})
    _replace(path, "own", own_buckets, before.join(sources, "source", "left_anti"), new, buckets)
    # A batch that is applied again may find own links renewed and these not: whatever a changed source held goes.
    _replace(path, "held", held_buckets, _read(spark, path, "held", held_buckets).join(sources, "source", "left_anti"), new, buckets)
    _replace(path, "cards", card_buckets, _read(spark, path, "cards", card_buckets).join(changed, "note_id", "left_anti"), fresh, buckets)


def own_links(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "own").drop("bucket")


def final_links(spark: SparkSession, path: str) -> DataFrame:
    """What notes hold now: the same rule as for all notes at once, by updated_at, then note_id."""
    return links.final_links(own_links(spark, path))
