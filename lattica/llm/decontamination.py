"""Operator 9, benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over every document.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Each benchmark item gives all windows of
ten consecutive words; a shorter item is one window. A document's windows are looked up by a rolling hash and verified
word by word. The windows are broadcast only in blocks of bounded size: beyond one block, the documents pass several
times, each time against one block, and the findings add up.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written

WINDOW = 10
#: Characters of benchmark text per broadcast block.
BLOCK_CHARS = 16_000_000

#: Bytes to words: letters lower, what isn't in a word a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FACTOR = 0x9E3779B97F4A7C15


def bench_words(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The windows of some items: vocabulary, hash table, and exact windows with their items."""

    def __init__(self, items: list[tuple[object, str | None]], length: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.exact: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in bench_words(text)]
            size = min(length, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.exact.setdefault(tuple(words[i : i + size]), set()).add(str(item))
        self.hashes = {}
        for size in {len(w) for w in self.exact}:
            rows = np.array([w for w in self.exact if len(w) == size], np.uint64)
            self.hashes[size] = np.unique(self._hash(rows.T))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out + c) * np.uint64(_FACTOR)
            out ^= out >> np.uint64(29)
        return out

    def find(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which words are hit, and the items found."""
        words = bench_words(text)
        n = len(words)
        hit, items = np.zeros(n, bool), set()
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, n)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, known in self.hashes.items():
            if n < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            h = self._hash([ids[at + k] for k in range(size)])
            at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            for i in at.tolist():
                found = self.exact.get(tuple(ids[i : i + size].tolist()))
                if found:
                    hit[i : i + size] = True
                    items |= found
        return n, hit, items


class Block:
    """A broadcast block of items under a name that no other block has."""

    def __init__(self, items):
        self.id, self.items = uuid.uuid4().hex, items

    @property
    def value(self):
        return self.items.value


_built: dict[tuple[str, int], Windows] = {}


def windows_of(block, length: int) -> Windows:
    """The windows of a broadcast block, built once in each worker; a worker keeps those of one block."""
    if (block.id, length) not in _built:
        _built.clear()
        _built[block.id, length] = Windows(block.value, length)
    return _built[block.id, length]


def blocks_of(bench: DataFrame, chars: int = BLOCK_CHARS):
    """The items in blocks of about ``chars`` characters, one block on the driver at a time."""
    total = bench.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    n = -(-total // chars) or 1
    for k in range(n):
        part = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else bench
        yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]


def scan(docs: DataFrame, bench: DataFrame, length: int = WINDOW, chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with bench_words (long), bench_spans (array of first word, end) and bench_items (array of strings).

    Needs text; other columns stay, columns of the added names are replaced. Null and empty texts, and items without
    words, hit nothing. Overlapping windows merge into one span. Repeated documents are scanned alike; repeated items
    count once by item_id. An empty benchmark or table gives no hits or no rows.
    """
    added = ("bench_words", "bench_spans", "bench_items")
    docs = docs.drop(*added)
    names = docs.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "bench_words long, bench_spans array<array<long>>, bench_items array<string>"])
    first = True
    for items in blocks_of(bench, chars):
        block = Block(docs.sparkSession.sparkContext.broadcast(items))

        def look(batches, block=block, first=first):
            windows = windows_of(block, length)
            for batch in batches:
                rows = []
                for i, x in enumerate(batch.column("text")):
                    n, hit, items = windows.find(x.as_py())
                    if not first:
                        for a, b in batch.column("bench_spans")[i].as_py():
                            hit[a:b] = True
                        items |= set(batch.column("bench_items")[i].as_py())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
                    rows.append((n, edges.tolist(), sorted(items)))
                new = zip(*rows, strict=True) if rows else [[]] * 3
                kinds = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(new, kinds, strict=True))], names=[*names, *added]
                )

        docs = (docs if first else written(docs, "decontamination")).mapInArrow(look, schema)
        first = False
    return docs


def without_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in _TOKEN.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", length: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) without the words that windows cover."""
    scanned, names = scan(docs, bench, length), docs.columns
    if remove == "documents":
        return scanned.filter(F.size("bench_spans") == 0).select(*names)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")

    def cut(batches):
        for batch in batches:
            texts = [without_spans(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("bench_spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return scanned.mapInArrow(cut, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("bench_spans") > 0).alias("contaminated"),
    )
