"""Pattern search over a trigram index: what a pattern must contain picks the notes that are worth looking at.

The index has, for each trigram of ASCII characters in lower-cased titles, texts, tags and keywords, lists of notes, a list for each
batch of notes that a task reads, in buckets by trigram and sorted; a trigram of a note is never a row of its own. A pattern's required trigrams come from its literal stretches. Notes
that have all of them are candidates, and the pattern decides among these. A pattern that requires none is answered by the
scan, so results never differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import fixed
from lattica.operators import search
from lattica.tables import parts_for

LISTS = "gram string, notes array<long>"
BUCKETS = 64
#: Bytes of texts cut at a time.
CUT_BYTES = 8 << 20


def literals(pattern: str) -> list[str]:
    """Stretches of characters that each match of a pattern contains, lower-cased. Unknown syntax: none."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []
    if parsed.state.flags & re.VERBOSE:
        return []
    found, run = [], []

    def cut() -> None:
        if run:
            found.append("".join(run).lower())
            run.clear()

    def walk(items) -> None:
        for kind, value in items:
            if kind is op.LITERAL:
                run.append(chr(value))
            elif kind is op.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
                cut()
                walk(value[2])
                cut()
            else:  # alternatives, sets, anchors, assertions and what may be absent say nothing
                cut()

    walk(parsed)
    cut()
    return found


def required(pattern: str, literal: bool = False) -> list[str]:
    """Trigrams of ASCII characters that a note must have somewhere to match."""
    runs = [pattern.lower()] if literal else literals(pattern)
    return sorted({g for r in runs for i in range(len(r) - 2) if (g := r[i : i + 3]).isascii()})


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def _lists(ids: np.ndarray, texts: pa.Array) -> pa.Table:
    """(gram, notes) of some texts: UTF-8 has bytes below 128 for ASCII characters alone."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[start:end].astype(np.int64) if end > start else np.zeros(0, np.int64)
    whose = np.repeat(np.arange(len(texts)), np.diff(offsets))
    code = raw[:-2] << 14 | raw[1:-1] << 7 | raw[2:]
    good = ((raw[:-2] | raw[1:-1] | raw[2:]) < 128) & (whose[:-2] == whose[2:])
    found = np.unique(code[good] * len(texts) + whose[:-2][good])
    code, note = found // max(len(texts), 1), found % max(len(texts), 1)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    each = code[first]
    names = np.stack([each >> 14, each >> 7 & 127, each & 127], 1).astype(np.uint8).tobytes().decode("ascii")
    lists = pa.LargeListArray.from_arrays(np.r_[first, len(code)], ids[note]).cast(pa.list_(pa.int64()))
    return pa.table({"gram": pa.array([names[i : i + 3] for i in range(0, len(names), 3)], pa.string()), "notes": lists})


def listed(notes: DataFrame) -> DataFrame:
    """(gram, notes): of each batch, which notes with keywords have a gram. Fields and list entries are apart; a gram never spans two."""
    apart = "\u00a0"  # no ASCII character
    text = F.lower(F.concat_ws(apart, "title", "content_text", "tags", "keywords"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["note_id"].to_numpy(zero_copy_only=False), batch["text"].cast(pa.string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(CUT_BYTES, ends[-1] if len(ends) else 0, CUT_BYTES)), len(ids)])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield from _lists(ids[lo:hi], texts.slice(lo, hi - lo)).to_batches()

    return notes.select("note_id", text.alias("text")).mapInArrow(cut, LISTS)


def grams(notes: DataFrame) -> DataFrame:
    """(gram, note_id), each once a note."""
    return listed(notes).select("gram", F.explode("notes").alias("note_id"))


def write(notes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The index of ``notes``. A bucket's lists are dealt to more tasks when the files of ``notes`` are larger, so none holds a bucket whole."""
    tasks = parts_for(notes)
    rows = listed(notes).withColumns({"bucket": _bucket(buckets), "part": F.pmod(F.xxhash64(F.get("notes", F.lit(0))), F.lit(-(-tasks // buckets)))})
    rows.repartition(max(tasks, buckets), "bucket", "part").drop("part").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, needed: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(note_id) of notes with all needed trigrams. Only their buckets are opened, and in these only their rows kept."""
    asked = spark.createDataFrame([(g,) for g in needed], "gram string")  # as long as the pattern
    touched = [r["b"] for r in asked.select(_bucket(buckets).alias("b")).distinct().collect()]
    held = spark.read.schema(LISTS + ", bucket int").parquet(path).filter(F.col("bucket").isin(touched) & F.col("gram").isin(needed))
    each = held.select("gram", F.explode("notes").alias("note_id"))
    return each.groupBy("note_id").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(needed)).select("note_id")


def matching(spark: SparkSession, path: str, notes: DataFrame, pattern: str, literal: bool = True, limit: int = fixed.RESULTS, buckets: int = BUCKETS) -> DataFrame:
    """The notes that ``search.matching`` finds, looked for among candidates alone."""
    needed = required(pattern, literal)
    some = notes.join(candidates(spark, path, needed, buckets), "note_id", "left_semi") if needed else notes
    return search.matching(some, pattern, literal, limit)
