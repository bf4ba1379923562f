"""Operator 5, quality rules: plain counts of every text, then a hashed n-gram log-likelihood ratio.

The n-grams are runs of four UTF-8 bytes, hashed to 65,536 buckets. One multinomial is counted over all documents (raw),
one over trusted documents (those that the labels call good, at most ``TRUSTED`` of them by a hash of the id). A text's
score is the mean over its n-grams of log(trusted / raw), so length doesn't matter; below ``THRESHOLD`` it is rejected.
The same rule decides every document: nothing is drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: The trusted sample is bounded by this many documents; their ids are broadcast.
TRUSTED = 20_000
#: Mean log ratio below which a text is rejected.
THRESHOLD = -0.6
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def gram_buckets(raw: bytes) -> np.ndarray:
    """Hash buckets of all runs of four bytes of a text."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.empty(0, np.uint32)
    grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return (grams * np.uint32(2654435761)) >> 16


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    two = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:
        two = np.unique(two, return_inverse=True)[1]
    key = two[:-1] * len(seen) + ids[2:]
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has none of anything."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return len(words), chars, symbols, repeats, repeated_words(words)


def gram_counts(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all documents and over the trusted ones.

    Each task counts its own documents and hands on one row per bucket, so what is shuffled and collected is bounded by
    the number of buckets, and a hot source makes no hot key.
    """
    ids = (
        labels.groupBy(F.col("doc_id").alias("trusted_id"))
        .agg(F.min("quality").alias("quality"))
        .filter("quality = 1 AND trusted_id IS NOT NULL")
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(trusted)
        .select("trusted_id")
    )
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    flagged = flagged.select("text", F.col("trusted_id").isNotNull().alias("trusted"))

    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            waiting: tuple[list, list] = ([], [])
            size = 0
            for text, good in zip(batch.column(0), batch.column(1), strict=True):
                grams = gram_buckets((text.as_py() or "").encode())
                waiting[0].append(grams)
                if good.as_py():
                    waiting[1].append(grams)
                size += len(grams)
                if size > 1 << 20:
                    for k in (0, 1):
                        totals[k] += np.bincount(np.concatenate([*waiting[k], np.empty(0, np.uint32)]).astype(np.int64), minlength=BUCKETS)
                        waiting[k].clear()
                    size = 0
            for k in (0, 1):
                totals[k] += np.bincount(np.concatenate([*waiting[k], np.empty(0, np.uint32)]).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[0][at]), pa.array(totals[1][at])], names=["bucket", "n", "good"])

    sums = flagged.mapInArrow(count, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.collect():  # at most BUCKETS rows
        raw[row["bucket"]], good[row["bucket"]] = row["n"], row["good"]
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(trusted / raw) per bucket; all 0 without trusted documents, so then nothing is rejected by it."""
    if not good.sum():
        return np.zeros(BUCKETS, np.float32)
    p = (good + SMOOTHING) / (good.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p / q).astype(np.float32)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """``docs`` with the base counts, base_failed, llr (double) and kept.

    Needs doc_id and text; other columns stay, columns of the added names are replaced. Null and empty texts have no
    words, so base_failed is true. Texts under four bytes have llr 0. Repeated rows are judged alike; an empty table
    stays empty; without trusted labels llr is 0 for all.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(*gram_counts(docs, labels, trusted)))
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")
    plain = docs.drop(*added, "base_failed", "kept")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), BASE, "llr double"])

    def score(batches):
        table = ratios.value
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py()
                grams = gram_buckets((text or "").encode())
                rows.append((*base_counts(text), float(table[grams].mean(dtype=np.float64)) if len(grams) else 0.0))
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.int64()] * 5 + [pa.float64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = plain.mapInArrow(score, schema).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels).drop("text")
