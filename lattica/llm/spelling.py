"""Operator 11, grouping spelling variants by rolling-hash deletions.

Words are counted where the texts are and summed by word. Two words differ by one replaced code point if both give the
same string without the code point at one place, and by one inserted if one of them gives the other without a code point.
Each word's deletions are integers: with the polynomial hash of everything before and after each place, a batch of words
is hashed by a few NumPy operations on one flat array, however long its words. Keys go to partitions by their upper bits
and are sorted; runs of one key name the words to compare. Strings have the last word: words of a run are grouped by what
they really leave without the code point, so hashes that collide join nothing.

No pairs are made among the words that share a replaced place: their number and their two most frequent words tell all.
An inserted code point makes a star around the shorter word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import forget, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: One run in so many loses a code point, by the checksum of document and run.
EVERY = 97
MIN_CHARS, MIN_COUNT = 5, 3
#: Distinct words that a task counts before it hands them on, and code points hashed at a time.
HELD, FLAT = 200_000, 1 << 20
#: Odd multiplier of the polynomial, its inverse modulo 2**64, and what sets keys of the two kinds apart.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WHOLE, SHORTER, REPLACED = 0, 1, 2


def count_words(docs: DataFrame, every: int = EVERY, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n) per task and word, so that a frequent word costs each task one row or few."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})
            found.clear()
            return made

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(RUN.findall((text or "").encode().translate(LOWER).decode())).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= min_chars:
                        found[run] += n
                if len(found) >= HELD:
                    yield out()
        if found:
            yield out()

    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(count, "word string, n long")


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the word, kind, place and 64-bit key: of each whole word, and of each deletion for both kinds of neighbours.

    A word's hash is the sum of code point times BASE**place, modulo 2**64. Without place i it is the prefix before i plus
    the suffix after i, divided by BASE once. Of equal code points in a row only the first deletion counts as a shorter
    word, for the others give the same one. Whole words and shorter words share keys; replaced ones also hold place and length.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - starts[row]
    power = np.ones(int(sizes.max(initial=1)), dtype=np.uint64)
    power[1:] = np.uint64(BASE)
    power = np.multiply.accumulate(power)  # wraps, as all sums here do
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(flat * power[place], dtype=np.uint64)])
    prefix = sums[:-1] - sums[starts][row]
    suffix = sums[starts + sizes][row] - sums[1:]
    without = prefix + suffix * np.uint64(INVERSE)
    whole = sums[starts + sizes] - sums[starts]
    same = np.zeros(len(flat), dtype=bool)
    same[1:] = (flat[1:] == flat[:-1]) & (place[1:] > 0)
    first = np.flatnonzero(~same)
    mark = (place.astype(np.uint64) << np.uint64(32)) + sizes[row].astype(np.uint64) + np.uint64(1)
    keys = np.concatenate([whole, without[first], without + mixed(mark)])
    kinds = np.repeat(np.array([WHOLE, SHORTER, REPLACED], dtype=np.int32), [len(words), len(first), len(flat)])
    places = np.concatenate([np.zeros(len(words), dtype=np.int64), place[first], place])
    return np.concatenate([np.arange(len(words)), row[first], row]), kinds, places, mixed(keys).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (fixed constants of the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_rows(words: DataFrame) -> DataFrame:
    """(key, kind, place, wid) of all words, some of a batch at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, wids = pdf["word"].tolist(), pdf["wid"].to_numpy()
            cuts = np.cumsum([len(w) for w in texts]) // FLAT if texts else np.empty(0)
            for lo, hi in runs(cuts):
                row, kind, place, key = deletion_keys(texts[lo:hi])
                for at in range(0, len(row), FLAT):
                    part = slice(at, at + FLAT)
                    yield pd.DataFrame({"key": key[part], "kind": kind[part], "place": place[part], "wid": wids[lo:hi][row[part]]})

    return words.select("word", "wid").mapInPandas(rows, "key long, kind int, place long, wid long")


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    bounds = [0, *edges.tolist(), len(keys)]
    return ((a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)


def meeting(keys: DataFrame) -> DataFrame:
    """Rows whose key others share: two places replaced, or a whole word and shorter ones. Sorted rows stream through."""

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        key, kind = pdf["key"].to_numpy(), pdf["kind"].to_numpy()
        _, run = np.unique(key, return_inverse=True)
        whole, shorter, replaced = (np.bincount(run, weights=kind == k)[run] for k in (WHOLE, SHORTER, REPLACED))
        return pdf[np.where(kind == REPLACED, replaced > 1, (whole > 0) & (shorter > 0))]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            done = int(np.searchsorted(pdf["key"].to_numpy(), pdf["key"].iloc[-1])) if len(pdf) else 0
            held = pdf.iloc[done:]
            if done:
                yield kept(pdf.iloc[:done])
        if held is not None and len(held):
            yield kept(held)

    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    radix = keys.repartition(parts, F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    return radix.mapInPandas(stream, "key long, kind int, place long, wid long")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) for words with near words: how many, and the most frequent, ties by code points.

    ``words`` (word, n, wid) holds each word once.
    """
    met = meeting(key_rows(words)).join(words, "wid")
    place = F.col("place").cast("int")
    left = F.concat(F.substring("word", F.lit(1), place), F.when(F.col("kind") == REPLACED, F.lit("\0")).otherwise(F.lit("")), F.substring("word", place + 2, F.length("word")))
    met = written(met.select(
        "word",
        "n",
        "kind",
        F.when(F.col("kind") == REPLACED, place).otherwise(F.lit(-1)).alias("at"),
        F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(left).alias("left"),
    ), "met")  # read by three parts of the plan
    others = met.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("at", "left").orderBy(F.col("n").desc(), "word")
    group = Window.partitionBy("at", "left")
    best = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    # A replaced place: all others of the group, the best of them the first, or the second for the first itself.
    replaced = others.filter(F.col("kind") == REPLACED).select(
        "word",
        (F.count(F.lit(1)).over(group) - 1).alias("n_near"),
        F.when(F.row_number().over(order) == 1, F.lead(best).over(order)).otherwise(F.first(best).over(order)).alias("best"),
    ).filter("n_near > 0")
    # A shorter word: the whole one is near each that gives it, and they are near it.
    whole = met.filter(F.col("kind") == WHOLE).select(F.col("word").alias("short"), F.col("n").alias("short_n"))
    star = others.filter(F.col("kind") == SHORTER).join(whole, F.col("left") == F.col("short"))
    one = F.lit(1).cast("long").alias("n_near")
    up = star.select("word", one, F.struct((-F.col("short_n")).alias("less"), F.col("short").alias("near")).alias("best"))
    down = star.select(F.col("short").alias("word"), one, best.alias("best"))
    both = replaced.unionByName(up).unionByName(down).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return both.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers doubled until none moves. A form is twice as frequent, so chains are short."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.filter("moved").isEmpty()
        forget(at)
        at = new
        if not moved:
            return at.select("word", "root")


def variants(docs: DataFrame, every: int = EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = 2) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Needs doc_id and text; other columns are ignored. A null text has no words, a null doc_id counts as the empty text,
    repeated rows count each, very long texts and words are whole, an empty table has no words. Of equally frequent near
    words the smallest in code points is the form.
    """
    total = count_words(docs, every, min_chars).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    words = written(total.withColumn("wid", F.monotonically_increasing_id()), "words")
    near = written(neighbours(words), "near")
    joined = words.join(near, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms"
    )
    forget(near)
    forget(words)
    found = roots(formed.filter("form IS NOT NULL"))
    return formed.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all ``documents``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(id || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS h FROM counted),
typed AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cut AS (SELECT word, n, i, length(word) AS size, substr(word, 1, i) || substr(word, i + 2) AS rest FROM places),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
chosen AS (SELECT p.word, any_value(n_near) AS n_near, min(near) AS near, any_value(top) AS top FROM pairs p JOIN best USING (word) WHERE near_n = top GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN near END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN chosen USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.at AS root FROM formed f JOIN walk USING (word) WHERE walk.next IS NULL
"""
