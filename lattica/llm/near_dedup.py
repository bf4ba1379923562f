"""Operator 3, MinHash near-duplicate removal by an LSH forest.

A document's set holds the hashes of its distinct runs of five words. Documents with equal sets collapse into one class
before anything is compared. Each class has a signature of ``TREES * DEPTH`` minimum hashes; each tree is one sorted order
of all classes, by the signature rotated to start at that tree's own hashes. Neighbours in an order that agree on at least
:func:`least_depth` leading hashes are candidates: where classes are sparse that is the whole bucket, where they are dense it is those
with the longest common prefix, so the depth at which classes meet adapts to each region. The orders are made by range
partitioning, which cuts a hot region into many tasks; what lies around a cut is compared afterwards.

What these neighbours leave is compared too: where more classes agree on the leading hashes than neighbours can cover, and
they are not one component yet, all pairs of two components are held against each other by whole signature, and confirmed
on full sets where they stand; a task gives the links that join its components, not the pairs. Such a bucket is cut into
chunks, and each two chunks meet in a task of their own.

Candidates whose signatures agree too little are dropped at a level that a true pair misses about once in 100,000 times.
The others are confirmed on full sets, in rounds that leave out what earlier rounds have already joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import forget, parts_for, written
from lattica.llm.components import components

WORDS = 5
TREES = 20
DEPTH = 5
#: Neighbours on each side in a sorted order.
REACH = 2
#: Hashes of a sorted order's key, two bytes each.
KEY_HASHES = 10
#: Classes of a crowded bucket, and bytes of their sets, that stand in one chunk; a task holds two chunks.
CHUNK, CHUNK_BYTES = 2048, 32 << 20
#: Partners of each class, by equal hashes, that are confirmed before all others of a crowded bucket.
FIRST = 8
#: Pairs whose signatures are compared at a time.
AT_A_TIME = 1 << 15
#: Ids of documents to be confirmed are broadcast up to so many (8 bytes each); beyond, texts are joined by shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20_240_501)
_FACTORS = (_rng.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _rng.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint32)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run; no words, no hashes."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    runs, steps = max(1, n - size + 1), min(size, n)
    h = np.full(runs, steps, np.uint64)
    for k in range(steps):
        h = (h ^ w[k : k + runs]) * _MIX
        h ^= h >> np.uint64(31)
    return np.unique(h)


def digest(hashed: bytes) -> bytes:
    """Tells sets apart, and orders those of one doc_id."""
    return hashlib.blake2b(hashed, digest_size=16).digest()


def signature(hashed: np.ndarray) -> bytes:
    """The low 16 bits of each minimum hash."""
    h = (hashed >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, h.shape[1], 2048):
        np.minimum(low, (h[:, at : at + 2048] * _FACTORS + _SHIFTS).min(axis=1), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16).tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), sig; digest and sig are null for an empty set."""

    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for x in batch.column(1):
                s = shingles(x.as_py(), hashes)
                rows.append((len(s), digest(s.tobytes()), signature(s)) if len(s) else (0, None, None))
            n, named, sig = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(named, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, sig binary")


def least_depth(percent: int) -> int:
    """Leading hashes on which candidates agree: as many as a pair at the threshold has in some tree, but for 3 in 100,000."""
    fits = [d for d in range(1, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES <= 3e-5]
    return max(fits, default=1)


def _neighbours(batches, depth: int, ends: bool):
    """Pairs of near rows of a sorted run that agree on the first ``depth`` hashes; with ``ends`` also the rows at both ends."""
    lead = 1 + 2 * depth
    held: list[tuple[bytes, int]] = []
    first: list[tuple[bytes, int]] = []
    for batch in batches:
        pairs = []
        for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(first) < REACH:
                first.append((key, at))
            for other, there in held:
                if there != at and other[:lead] == key[:lead]:
                    pairs.append((min(at, there), max(at, there)))
            held = [*held[1 - REACH :], (key, at)] if REACH > 1 else [(key, at)]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])
    if ends:
        rows = list(dict.fromkeys([*first, *held]))
        keys, at = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at, pa.int64()), pa.nulls(len(at), pa.int64())], names=["key", "a", "b"])


def candidates(classes: DataFrame, parts: int, depth: int = DEPTH) -> DataFrame:
    """Distinct pairs (a < b) of classes (id, sig) that are near in some tree's order, with ``agree``, equal hashes in 100.

    Ends of partitions are a few rows for each; they are sorted together, so that no pair is lost at a cut.
    """
    ring = F.concat("sig", F.substring("sig", 1, 2 * KEY_HASHES))
    tree = F.expr(f"explode(sequence(0, {TREES - 1}))")
    rows = classes.select("id", ring.alias("ring"), tree.alias("tree"))
    key = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(ring, 1 + tree * {2 * DEPTH}, {2 * KEY_HASHES})"))
    rows = rows.select(key.alias("key"), "id")
    near = rows.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    near = written(near.mapInArrow(lambda b: _neighbours(b, depth, True), "key binary, a long, b long"), "neighbours")
    ends = near.filter("key IS NOT NULL").select("key", F.col("a").alias("id")).orderBy("key", "id").coalesce(1)
    cut = ends.mapInArrow(lambda b: _neighbours(b, depth, False), "key binary, a long, b long")
    pairs = near.filter("key IS NULL").select("a", "b").unionByName(cut.select("a", "b")).distinct()
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(classes.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def agree(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            n = (x == y).sum(axis=1) * 100 // x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n.astype(np.int32))], names=["a", "b", "agree"])

    return both.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long, agree int")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _cell_links(ids, component, n, sigs, sets, side, tree: int, percent: int, depth: int):
    """Links (a, b) of one cell, confirmed on full sets, that join its components.

    Pairs are of two components, near in size, agree enough, and are in no earlier tree's bucket together. Each class is
    first held against the few that agree with it most, then against all others that aren't joined with it by then.
    """
    component, rows = component.copy(), max(1, AT_A_TIME // len(ids))
    across = side.min() != side.max()
    for most in (FIRST, len(ids)):
        for at in range(0, len(ids), rows):
            i = slice(at, at + rows)
            fit = component[i, None] != component[None, :]
            fit &= 100 * np.minimum(n[i, None], n[None, :]) >= percent * np.maximum(n[i, None], n[None, :])
            fit &= side[i, None] < side[None, :] if across else np.arange(at, min(at + rows, len(ids)))[:, None] < np.arange(len(ids))[None, :]
            x, y = np.nonzero(fit)
            if not len(x):
                continue
            x += at
            same = sigs[x] == sigs[y]
            agree = np.count_nonzero(same, axis=1) * 100 // same.shape[1]
            good = agree >= percent - 17
            x, y, agree, led = x[good], y[good], agree[good], same[good].reshape(-1, TREES, DEPTH)[:, : tree + 1, :depth].all(axis=2)
            here = led[:, tree] & ~led[:, :tree].any(axis=1)
            x, y, agree = x[here], y[here], agree[here]
            order = np.lexsort((y, -agree, x))
            x, y = x[order], y[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            for p, q in zip(x[place < most].tolist(), y[place < most].tolist(), strict=True):
                if component[p] != component[q] and alike(np.frombuffer(sets[p], np.uint64), np.frombuffer(sets[q], np.uint64), percent):
                    component[component == component[q]] = component[p]
                    yield min(ids[p], ids[q]), max(ids[p], ids[q])


def crowded(docs: DataFrame, classes: DataFrame, percent: int, depth: int) -> DataFrame:
    """Links (a, b) that join classes (id, sig, n, component) of two components in buckets too large for neighbours.

    A bucket holds the classes that agree on the first ``depth`` hashes of a tree. All its pairs meet, in chunks that meet
    two by two, with their full sets; what comes out are confirmed links, fewer than a cell has classes.
    """
    rows = classes.select("id", "component", "n", "sig", F.expr(f"explode(sequence(0, {TREES - 1}))").alias("tree"))
    key = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(sig, 1 + tree * {2 * DEPTH}, {2 * depth})"))
    rows = rows.select(key.alias("key"), "id", "component", "n")
    size = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.col("n") * 8).alias("bytes"), F.min("component").alias("low"), F.max("component").alias("high"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    size = written(size.filter((F.col("members") > REACH + 1) & (F.col("low") < F.col("high"))).select("key", chunks.alias("chunks")), "crowded")
    dealt = rows.select("key", "id").join(size, "key")
    sets = written(set_table(docs, dealt.select("id").distinct()), "sets")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.expr("explode(sequence(0, chunks - 1))"))
    dealt = dealt.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "id")
    dealt = dealt.join(classes.select("id", "component", "n", "sig").join(sets, "id"), "id")
    cells = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "side", "id", "component", "n", "sig", "hashes")

    def compare(batches):
        last, held = None, []

        def pairs():
            whole = pa.concat_tables(held).combine_chunks()
            if whole.num_rows < 2:
                return
            side, ids, component, n = (whole.column(c).to_numpy() for c in ("side", "id", "component", "n"))
            sigs = np.frombuffer(b"".join(whole.column("sig").to_pylist()), np.uint16).reshape(whole.num_rows, -1)
            if last[1] != last[2] and side.min() == side.max():
                return
            found = list(_cell_links(ids, component, n, sigs, whole.column("hashes").to_pylist(), side, last[0][0], percent, depth))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cell = list(zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y")), strict=True))
            starts = [k for k in range(len(cell)) if not k or cell[k] != cell[k - 1]]
            table = pa.Table.from_batches([batch])
            for begin, end in zip(starts, [*starts[1:], len(cell)], strict=True):
                if cell[begin] != last and held:
                    yield from pairs()
                    held = []
                last = cell[begin]
                held.append(table.slice(begin, end - begin))
        if held:
            yield from pairs()

    return cells.mapInArrow(compare, "a long, b long").distinct()


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes) of the documents in ``ids``: whole sets, as sorted 64-bit numbers; of several texts under one id the set of the least digest."""
    wanted = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")

    def hashed(batches):
        hashes = WordHashes()
        for batch in batches:
            out = [shingles(x.as_py(), hashes).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, out), pa.binary()), pa.array(out, pa.binary())], names=["id", "digest", "hashes"])

    return texts.mapInArrow(hashed, "id long, digest binary, hashes binary").groupBy("id").agg(F.min_by("hashes", "digest").alias("hashes"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with linked: 100 * intersection >= percent * union of the full sets."""
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    rows = rows.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").select("a", "b", "ha", "hb")

    def compare(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                linked.append(alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(compare, "a long, b long, linked boolean")


def _best(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def joined(docs: DataFrame, pairs: DataFrame, links: DataFrame | None, label: DataFrame | None, percent: int):
    """``links`` and their components ``label`` with all confirmed ``pairs`` (a, b, agree) added; and the tables they need no more."""
    if pairs.isEmpty():
        return links, label, []
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = written(set_table(docs, ids), "sets")
    left, tables = pairs, [sets]
    for turn in range(3):
        if left.isEmpty():
            break
        if turn == 0:
            ends = left.withColumn("end", F.explode(F.array("a", "b")))
            chosen = _best(ends, "end")
        elif turn == 1:
            chosen = _best(left, "ca", "cb")
        else:
            chosen = left.select("a", "b")
        checked = written(confirmed(chosen, sets, percent), "checked")
        good = checked.filter("linked").select("a", "b")
        links = good if links is None else links.unionByName(good)
        label = written(components(links), "components")
        of = lambda x, label=label: label.select(F.col("id").alias(x), F.col("component").alias("c" + x))
        left = left.select("a", "b", "agree").join(checked.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = left.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")
        left = written(left.select("a", "b", "agree", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")), "left")
        tables += [left, checked]
    return links, label, tables


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Documents are linked if the Jaccard similarity of their sets is at least ``percent`` in a hundred. Null, empty and
    blank texts have the empty set and are linked with nothing; a null doc_id is linked with nothing either, has a null
    component_id and is kept. Rows that repeat a doc_id are one document; where their texts differ, each is linked with equal
    sets, and the one of the least digest is compared with others, so reruns agree. An empty table gives no rows.
    """
    parts = parts_for(docs)
    sigs = written(signed(docs), "signatures")
    classes = sigs.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = written(classes, "classes")
    one = classes.groupBy("id").agg(F.min_by(F.struct("sig", "n"), "digest").alias("c")).select("id", "c.sig", "c.n")
    pairs = written(candidates(one.select("id", "sig"), parts, least_depth(percent)).filter(F.col("agree") >= percent - 17), "pairs")
    links, label, tables = joined(docs, pairs, None, None, percent)
    component = one if label is None else one.join(label, "id", "left")
    component = component.withColumn("component", F.col("id") if label is None else F.coalesce("component", "id"))
    more = written(crowded(docs, written(component, "classes"), percent, least_depth(percent)), "links")
    if not more.isEmpty():
        links = more if links is None else links.unionByName(more)
        label = written(components(links), "components")
    tables += [pairs, more]
    member = classes.select("digest", "id")
    if label is not None:
        member = member.join(label, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    else:
        member = member.select("digest", F.col("id").alias("component"))
    out = sigs.join(member, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    for x in tables:
        forget(x)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
