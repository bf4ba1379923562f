"""Keywords of notes: word frequency, weighted by length and optionally by rarity, ranked per note."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import fixed
from lattica.functions import text as T
from lattica.tables import dealt, parts_for, stored


def term_counts(notes: DataFrame, *keep: str) -> DataFrame:
    """(user_id, note_id, word, tf, first_pos, and columns to keep): words of title, title again and text.

    A note's text travels once, to the note's partition; its words are cut, counted and later ranked there and never travel.
    Partitions are as many as the texts need, so a task holds no more of them when there are more notes.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit("")))
    own = dealt(notes.select("user_id", "note_id", *keep, text.alias("text")), "note_id", parts=parts_for(notes))
    runs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))
    w = own.select("user_id", "note_id", *keep, F.posexplode(runs).alias("pos", "word"))
    w = w.filter(~F.col("word").isin(fixed.KEYWORD_STOPWORDS))
    return w.groupBy("user_id", "note_id", *keep, "word").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def _ranked(scored: DataFrame, top: int, *by: str) -> DataFrame:
    number = T.whole_number(F.col("word"))
    order = [F.col("score").desc(), F.when(number.isNull(), 1).otherwise(0), F.coalesce(number, F.lit(0)), F.col("first_pos")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def keywords(notes: DataFrame, top: int = fixed.KEYWORDS_PER_NOTE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, note_id, keyword, score, rank, and columns of the note to keep) without a corpus: rarity is a constant.

    Notes without words give no rows.
    """
    score = F.round(F.col("tf") * (F.log(F.lit(2.0)) + 1) * (1 + F.log(F.length("word").cast("double"))), 6)
    return _ranked(term_counts(notes, *keep).withColumn("score", score), top, "note_id").select("user_id", "note_id", F.col("word").alias("keyword"), "score", "rank", *keep)


def corpus_keywords(notes: DataFrame, top: int = fixed.KEYWORDS_PER_NOTE) -> DataFrame:
    """Keywords with each user's notes as the corpus. Words are counted once; document frequencies are joined on (user, word)."""
    counts, parts = stored(term_counts(notes), "counts"), parts_for(notes)
    counts = dealt(counts, "user_id", "word", parts=parts)
    df = counts.groupBy("user_id", "word").agg(F.count("*").alias("df"))
    size = notes.groupBy("user_id").agg(F.count("*").alias("n"))
    scored = counts.join(df, ["user_id", "word"]).join(size, "user_id")
    rare = F.log((F.greatest("n", F.lit(1)) + 1.0) / (F.col("df") + 1.0)) + 1
    score = F.round(F.col("tf") * rare * (1 + F.log(F.length("word").cast("double"))), 6)
    scored = dealt(scored.select("user_id", "note_id", "word", "first_pos", score.alias("score")), "note_id", parts=parts)
    return _ranked(scored, top, "note_id").select("user_id", "note_id", F.col("word").alias("keyword"), "score", "rank")


def topic_colours(notes: DataFrame, kw: DataFrame) -> DataFrame:
    """(user_id, note_id, top_keyword, colour): notes with one top keyword share a colour, in order of first appearance."""
    top = notes.select("user_id", "note_id").join(kw.filter("rank = 1").select("note_id", "keyword"), "note_id", "left")
    top = top.withColumn("top_keyword", F.coalesce("keyword", F.lit("__uncategorised__")))
    first = top.groupBy("user_id", "top_keyword").agg(F.min("note_id").alias("first"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("first")) - 1
    colour = F.get(F.array(*map(F.lit, fixed.TOPIC_COLOURS)), F.pmod(nth, F.lit(len(fixed.TOPIC_COLOURS))))
    return top.join(first.withColumn("colour", colour), ["user_id", "top_keyword"]).select("user_id", "note_id", "top_keyword", "colour")
