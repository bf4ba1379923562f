"""Search: by tag, recency, meaning (weighted keyword hits), relevance and pattern."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import fixed
from lattica.functions import text as T


def query_terms(query: str) -> list[str]:
    """The words of a query that count, in order."""
    stop = set(fixed.KEYWORD_STOPWORDS)
    return [w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 2 and w not in stop]


def query_keywords(query: str, top: int = fixed.KEYWORDS_PER_NOTE) -> list[str]:
    """The keywords of a query or of another text, in one pass over its words."""
    words = query_terms(query)
    counts, first = Counter(words), {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    score = {w: round(n * (math.log(2) + 1) * (1 + math.log(len(w))), 6) for w, n in counts.items()}
    number = {w: int(w) if re.fullmatch("0|[1-9][0-9]{0,8}", w) else None for w in counts}
    return sorted(score, key=lambda w: (-score[w], number[w] is None, number[w] or 0, first[w]))[:top]


def _pattern(query: str, literal: bool) -> str:
    return "(?i)" + (re.escape(query) if literal else query)


def with_keywords(notes: DataFrame, kw: DataFrame) -> DataFrame:
    """Notes with their keywords as an array in rank order."""
    lists = kw.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k")).select("note_id", F.col("k.keyword").alias("keywords"))
    return notes.join(lists, "note_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def by_tag(notes: DataFrame, query: str = "", tags: str = "", literal: bool = True, limit: int = fixed.RESULTS) -> DataFrame:
    """Notes whose tags, keywords or title match; of a list of tags only the first counts. Nothing asked: no rows."""
    asked = re.sub("^#+", "", query.strip().lower()) or next(iter(T.csv_list(tags)), "")
    if not asked:
        return notes.limit(0)
    p = _pattern(asked, literal)
    hit = F.exists("tags", lambda x: x.rlike(p)) | F.exists("keywords", lambda x: x.rlike(p)) | F.col("title").rlike(p)
    return notes.filter(hit).orderBy("note_id").limit(limit)


def recent(notes: DataFrame, limit: int = fixed.RECENT) -> DataFrame:
    return notes.orderBy(F.col("updated_at").desc(), "note_id").limit(limit)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """The best rows by score, none without any. Scores are tested after the limit: a test before it would work each out twice."""
    return scored.orderBy(F.col("score").desc(), "note_id").limit(limit).filter("score > 0")


def semantic(notes: DataFrame, query: str, limit: int = fixed.RESULTS) -> DataFrame:
    """3 for each keyword of the query among the note's, 2 if the title contains it, 1 if the text does; 5 for the whole query in the title."""
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content_text", F.lit("")))
    score: Column = F.when(F.contains(title, F.lit(query.lower())), 5).otherwise(0)
    for k in query_keywords(query):
        score = score + F.when(F.array_contains(F.transform("keywords", F.lower), k), 3).otherwise(0)
        score = score + F.when(F.contains(title, F.lit(k)), 2).otherwise(0) + F.when(F.contains(body, F.lit(k)), 1).otherwise(0)
    return _best(notes.withColumn("score", score), limit)


def _count(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def relevant(notes: DataFrame, query: str, limit: int = fixed.RESULTS) -> DataFrame:
    """Sum over all terms of the query, repeats included, and the fields title, text and tags of the term's share of the field's words.

    A field is cut into words once, however many terms there are: the words that are terms, and how many words there are, go on.
    """
    fields = (F.col("title"), F.col("content_text"), F.array_join("tags", " "))
    terms, score = Counter(query_terms(query)), F.lit(0.0)
    if not terms:
        return _best(notes.withColumn("score", score), limit)

    def met(words: Column) -> Column:
        return F.struct(F.filter(words, lambda w: w.isin(list(terms))).alias("hits"), F.greatest(F.size(F.array_remove(words, "")), F.lit(1)).cast("double").alias("size"))

    # A list of one element: its words are bound to a name, so they aren't cut again for each use.
    found = [F.get(F.transform(F.array(T.words(field)), met), F.lit(0)).alias(f"field{i}") for i, field in enumerate(fields)]

    def shares(f: Column) -> Column:
        return F.array(*[n * _count(f["hits"], t) / f["size"] for t, n in terms.items()])

    per_field = F.flatten(F.transform(F.array(*found), shares))
    return _best(notes.withColumn("score", F.round(F.aggregate(per_field, score, lambda a, b: a + b), 6)), limit)


def matching(notes: DataFrame, query: str, literal: bool = True, limit: int = fixed.RESULTS) -> DataFrame:
    """A pattern in title, text, tags or keywords."""
    p = _pattern(query, literal)
    hit = F.col("title").rlike(p) | F.col("content_text").rlike(p) | F.exists("tags", lambda x: x.rlike(p)) | F.exists("keywords", lambda x: x.rlike(p))
    return notes.filter(F.coalesce(hit, F.lit(False))).orderBy("note_id").limit(limit)


def only_tagged(found: DataFrame, tags: str) -> DataFrame:
    """Results that carry one of the tags, exactly. Applied to what a search returned, after its limit."""
    return found.filter(F.arrays_overlap("tags", F.array(*map(F.lit, T.csv_list(tags)))))


def results(found: DataFrame, query: str = "") -> DataFrame:
    """What a search shows of each note."""
    return found.select("note_id", "title", F.array_join("tags", "|").alias("tags"), F.array_join("keywords", "|").alias("keywords"), T.snippet(F.col("content_text"), query).alias("snippet"), "updated_at")


def search(notes: DataFrame, query: str = "", mode: str = "keyword", tags: str = "") -> DataFrame:
    """All branches. With a query and tags, a keyword search keeps only tagged results."""
    query = query.strip()
    if mode == "tags" or (not query and T.csv_list(tags)):
        return results(by_tag(notes, query, tags))
    if not query:
        return results(recent(notes))
    if mode == "semantic":
        return results(semantic(notes, query), query)
    found = relevant(notes, query)
    return results(only_tagged(found, tags) if T.csv_list(tags) else found, query)
