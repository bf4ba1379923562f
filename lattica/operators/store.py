"""Changes to notes as set operations: a change takes tables and returns the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import fixed
from lattica.functions import text as T


def created(requests: DataFrame) -> DataFrame:
    """New notes: a default title, no keywords, no links."""
    return requests.select("note_id", "user_id", T.default(F.col("title"), "Untitled Note").alias("title"), F.coalesce("content_text", F.lit("")).alias("content_text"), F.array().cast("array<string>").alias("keywords"))


def updated(notes: DataFrame, patch: DataFrame) -> DataFrame:
    """Notes after a patch (note_id and any columns); null leaves a value as it is, and only owners' patches count."""
    columns = [c for c in patch.columns if c not in ("note_id", "user_id")]
    changes = patch.select("note_id", *(["user_id"] if "user_id" in patch.columns else []), *(F.col(c).alias("new_" + c) for c in columns))
    keys = [c for c in ("note_id", "user_id") if c in changes.columns]
    joined = notes.join(changes, keys, "left")
    return joined.select(*(F.coalesce("new_" + c, c).alias(c) if c in columns else F.col(c) for c in notes.columns))


def owned(notes: DataFrame, note_id: int, user_id: str) -> DataFrame:
    """One note if it is the user's, else no rows."""
    return notes.filter((F.col("note_id") == note_id) & (F.col("user_id") == user_id))


def upserted(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """Notes with those of ``changed`` replaced or added."""
    return notes.join(changed.select("note_id"), "note_id", "left_anti").unionByName(changed, allowMissingColumns=True)


def starred(notes: DataFrame, stars: DataFrame) -> DataFrame:
    return notes.join(stars, "note_id", "left_semi")


def orphan_versions(versions: DataFrame, notes: DataFrame) -> DataFrame:
    """Versions whose note is gone: deletes leave them."""
    return versions.join(notes.select("note_id"), "note_id", "left_anti")


def user_violations(users: DataFrame) -> DataFrame:
    """(user_id, rule) for each rule that a user breaks."""
    name, email = T.trimmed(F.coalesce("name", F.lit(""))), F.lower(T.trimmed(F.coalesce("email", F.lit(""))))
    username = T.trimmed(F.coalesce("username", F.lit("")))
    rules = {
        "name required": name == "",
        "name too short": (name != "") & (F.length(name) < 2),
        "name too long": F.length(name) > 80,
        "username required": username == "",
        "username too short": (username != "") & (F.length(username) < 3),
        "email required": email == "",
        "email malformed": (email != "") & ~email.rlike(r"^\S+@\S+\.\S+$"),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return users.select("user_id", F.explode(broken).alias("rule"))


def note_violations(notes: DataFrame) -> DataFrame:
    rules = {"user required": F.col("user_id").isNull(), "title required": T.trimmed(F.coalesce("title", F.lit(""))) == "", "title too long": F.length("title") > fixed.TITLE_CHARS}
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return notes.select("note_id", F.explode(broken).alias("rule"))


def link_violations(links: DataFrame) -> DataFrame:
    """(source, target, rule) for each rule that a link (user_id, source, target, strength, shared_count) breaks."""
    rules = {
        "user required": F.col("user_id").isNull(),
        "source required": F.col("source").isNull(),
        "target required": F.col("target").isNull(),
        "strength required": F.col("strength").isNull(),
        "strength below 0": F.col("strength") < 0,
        "strength above 1": F.col("strength") > 1,
        "shared count below 0": F.col("shared_count") < 0,
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return links.select("source", "target", F.explode(broken).alias("rule"))


def taken(users: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, field): which requested accounts exist already, and by which field; the email is named first."""
    email, name = F.lower(F.col("r.email")), F.col("r.username")
    by = users.select(F.lower("email").alias("found"), F.lit("Email").alias("field")).unionByName(users.select(F.col("username").alias("found"), F.lit("Username").alias("field"))).distinct()
    asked = requests.alias("r").select("request_id", F.explode(F.array(F.struct(email.alias("found"), F.lit("Email").alias("field")), F.struct(name.alias("found"), F.lit("Username").alias("field")))).alias("x"))
    hits = asked.select("request_id", "x.found", "x.field").join(by, ["found", "field"], "left_semi")
    return hits.groupBy("request_id").agg(F.min("field").alias("field"))


def public(users: DataFrame) -> DataFrame:
    """Users without their passwords."""
    return users.drop("password")


def with_tag(notes: DataFrame, tag: str) -> DataFrame:
    """Notes with a tag appended unless it is there."""
    return notes.withColumn("tags", F.array_distinct(F.concat(F.col("tags"), F.array(T.tag(F.lit(tag))))))
