"""Operator 10, removal of long repeated substrings by column-wise construction over many documents.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes. Candidates come from anchors: of all
runs of ``ANCHOR`` bytes, those with the smallest hash in some window of ``length`` bytes. Equal strings of that length
select equal anchors at equal places, so two documents share such a string only where they share an anchor, and then at the
same distance from it. Identical documents collapse to one first, identical surroundings of an anchor as well.

The different surroundings (segments) of shared anchors stand in a table with the anchors in one column. It is read from
the last column to the first: each round takes one symbol from every segment, moves the segments into the order of their
suffixes (the symbols in that order are this round's column of the collection's Burrows-Wheeler transform), and updates
the common prefixes of neighbours. Where a common prefix reaches ``length``, the string repeats. Columns lie in one
sequential file on the executor's own disk when they outgrow memory; it goes when the block is done.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import forget, parts_for, written

LENGTH = 400
ANCHOR = 100
#: Long texts are hashed in pieces of so many bytes.
PIECE = 1 << 20
#: Segments of whole anchors that are ordered together.
BLOCK = 16_384
#: Bytes of a block's columns that may stay in memory.
IN_MEMORY = 64 << 20
#: Ids of involved documents are broadcast up to so many (8 bytes each); beyond, all texts are shuffled for the join.
BROADCAST_IDS = 500_000

#: An anchor that occurs more often is dealt to so many tasks when anchors are looked up.
HOT, SALTS = 5_000, 64

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
    return _powers[kind][:n]


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each window of ``w`` values."""
    n = len(x)
    edge = x.max() if best is np.minimum else x.min()
    rows = np.concatenate([x, np.full(-n % w, edge, x.dtype)]).reshape(-1, w)
    left = best.accumulate(rows, axis=1).ravel()
    right = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of a text: in every window of ``length`` bytes all runs with the smallest hash."""
    n, w = len(raw), length - k + 1
    hashes, places = [], []
    for at in range(0, n - length + 1, PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE + length - 1, n - at), at).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _power("down", _BASE, len(b)), dtype=np.uint64)])
        h = (sums[k:] - sums[:-k]) * _power("up", _INVERSE, len(b) - k + 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = _sliding(h, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        chosen = np.flatnonzero(h == _sliding(np.concatenate([pad, low, pad]), w, np.maximum))
        hashes.append(h[chosen])
        places.append(chosen + at)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def repeats(segments: list[bytes], offsets: list[int], counts: list[int], length: int = LENGTH, k: int = ANCHOR) -> np.ndarray:
    """Whether the window of ``length`` that starts in a column repeats: a row per column up to the anchor's.

    offsets: where the anchor starts in each segment; counts: how often each segment occurs.
    """
    m, reach = len(segments), length - k
    width = 2 * reach + k
    held = tempfile.TemporaryFile() if m * width > IN_MEMORY else None
    table = np.memmap(held, np.uint8, "w+", shape=(width, m)) if held else np.empty((width, m), np.uint8)
    step = max(1, (4 << 20) // width)
    starts = np.array([reach - x for x in offsets])
    ends = starts + np.array([len(x) for x in segments])
    for at in range(0, m, step):  # 0xFF doesn't occur in UTF-8
        rows = np.full((min(step, m - at), width), 0xFF, np.uint8)
        for i, (s, a) in enumerate(zip(segments[at : at + step], starts[at : at + step], strict=True)):
            rows[i, a : a + len(s)] = np.frombuffer(s, np.uint8)
        table[:, at : at + step] = rows.T
    often = np.array(counts) > 1
    found = np.zeros((reach + 1, m), bool)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # common[i]: prefix shared by suffixes i - 1 and i
    for column in range(width - 1, -1, -1):
        symbol = table[column][order]
        moved = np.argsort(symbol, kind="stable")
        new = np.zeros(m + 1, np.int32)
        same = np.flatnonzero(symbol[moved[1:]] == symbol[moved[:-1]]) + 1
        if len(same):
            a, b = moved[same - 1] + 1, moved[same]
            near = a == b
            new[same[near]] = common[b[near]] + 1
            if not near.all():
                a, b, far = a[~near], b[~near] + 1, same[~near]
                new[far] = np.minimum.reduceat(common, np.stack([a, b], axis=1).ravel())[::2] + 1
        order, common = order[moved], new
        if column <= reach:
            long = common >= length
            found[column, order] = long[:-1] | long[1:] | often[order]
    columns = np.arange(reach + 1)[:, None]
    found &= (columns >= starts) & (columns + length <= ends)
    if held:
        del table
        held.close()
    return found


def _spans(starts: np.ndarray, length: int) -> list[int]:
    """Merged (start, end) of windows, flat."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length], axis=1).ravel().tolist()


def _order_blocks(batches, length: int):
    """Rows (h, seg, offset, sd, m) sorted by h, in blocks of whole anchors; out come the spans of segments that occur once."""
    held: list[tuple] = []

    def work(rows):
        found = repeats([r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows], length)
        out = []
        for i, (h, _, offset, sd, m) in enumerate(rows):
            if m == 1:
                spans = _spans(np.flatnonzero(found[:, i]) - (length - ANCHOR) + offset, length)
                if spans:
                    out.append((h, sd, spans))
        h, sd, spans = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sd, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["h", "sd", "spans"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "seg", "anchor_at", "sd", "m")), strict=True):
            if len(held) >= BLOCK and row[0] != held[-1][0]:
                yield work(held)
                held = []
            held.append(row)
    if held:
        yield work(held)


def _merged(batches):
    """Texts and their spans to what is kept of them."""
    import hashlib

    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw, kept, done, n = text.as_py().encode(), hashlib.sha256(), 0, 0
            at = np.array([[s["s"], s["e"]] for s in spans.as_py()]).reshape(-1, 2)
            at = at[np.argsort(at[:, 0], kind="stable")]
            reach = np.maximum.accumulate(at[:, 1])
            new = np.concatenate([[0], np.flatnonzero(at[1:, 0] > reach[:-1]) + 1])
            removed = 0
            for a, b in zip(at[new, 0].tolist(), reach[np.concatenate([new[1:] - 1, [len(at) - 1]])].tolist(), strict=True):
                kept.update(raw[done:a])
                done, n, removed = b, n + 1, removed + b - a
            kept.update(raw[done:])
            rows.append((removed, n, kept.hexdigest()))
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("did"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["did", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, table, spans): texts with did, a number for each id and text; a row (did, doc_id, sha, n_bytes, copies) per
    document; and (did, spans) of the documents without copies in which strings repeat."""
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    texts = docs.select("doc_id", text.alias("text"), sha.alias("sha")).withColumn("did", F.xxhash64("doc_id", "sha"))

    def find(batches):
        for batch in batches:
            h, at = [], []
            for x in batch.column("text"):
                hashes, places = anchors(x.as_py().encode(), length)
                h.append(hashes.tobytes())
                at.append(places.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("did", "doc_id", "sha", "n_bytes")), pa.array(h, pa.binary()), pa.array(at, pa.binary())],
                names=["did", "doc_id", "sha", "n_bytes", "h", "at"],
            )

    table = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).select("did", "doc_id", "sha", "n_bytes", "text")
    table = written(table.mapInArrow(find, "did long, doc_id long, sha string, n_bytes long, h binary, at binary"), "anchors")
    parts = parts_for(docs)
    classes = written(table.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.min("did").alias("rep")), "classes")

    def spread(batches):
        for batch in batches:
            h = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("h")]
            at = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("at")]
            if h:
                did = np.repeat(batch.column("did").to_numpy(), [len(x) for x in h])
                yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(np.concatenate(h)), pa.array(np.concatenate(at).astype(np.int64))], names=["did", "h", "at"])

    one = table.join(classes.select(F.col("rep").alias("did")), "did", "left_semi").dropDuplicates(["did"])
    found = one.select("did", "h", "at").mapInArrow(spread, "did long, h long, at long")
    counted = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    # An anchor in many documents is looked up in SALTS tasks.
    shared = counted.select("h", F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), (F.col("n") > HOT).alias("hot"))
    shared = written(shared, "shared")
    hot = shared.filter("hot").select("h").distinct()
    few_hot = hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hot = F.broadcast(hot) if few_hot else hot
    salted = found.join(hot.withColumn("hot", F.lit(True)), "h", "left")
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("did", "at"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    hits = salted.join(shared.select("h", "salt"), ["h", "salt"]).groupBy("did").agg(F.collect_list(F.struct("at", "h")).alias("hits"))
    hits = written(hits, "hits")
    ids = hits.select("did")
    few = hits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    used = texts.select("did", "text").join(F.broadcast(ids), "did", "left_semi") if few else texts.select("did", "text")

    def cut(batches):
        for batch in batches:
            rows, sent = [], set()
            for did, text, hits in zip(batch.column("did"), batch.column("text"), batch.column("hits"), strict=True):
                raw, did = text.as_py().encode(), did.as_py()
                for x in hits.as_py():
                    a = max(0, x["at"] - length + ANCHOR)
                    seg = raw[a : x["at"] + length]
                    sd = xxhash.xxh3_64_intdigest(seg + (x["at"] - a).to_bytes(4, "little")) - (1 << 63)
                    rows.append((x["h"], sd, did, a, x["at"] - a, len(seg), None if (x["h"], sd) in sent else seg))
                    sent.add((x["h"], sd))
            if rows:
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "sd", "did", "start", "anchor_at", "size", "seg"])

    used = used.dropDuplicates(["did"]).join(hits, "did") if not few else used.join(hits, "did").dropDuplicates(["did"])
    segments = written(used.select("did", "text", "hits").mapInArrow(cut, "h long, sd long, did long, start long, anchor_at int, size int, seg binary"), "segments")
    often = segments.groupBy("h", "sd").agg(F.count("*").alias("m"))
    kinds = often.groupBy("h").agg(F.count("*").alias("kinds"))
    often = written(often.join(kinds.filter("kinds > 1"), "h", "left").select("h", "sd", "m", F.col("kinds").isNotNull().alias("mixed")), "counts")
    texts_of = segments.filter("seg IS NOT NULL").select("h", "sd", "anchor_at", "seg").join(often.filter("mixed"), ["h", "sd"]).dropDuplicates(["h", "sd"])
    ordered = texts_of.select("h", "seg", "anchor_at", "sd", "m").repartition(parts, "h").sortWithinPartitions("h")
    single = written(ordered.mapInArrow(lambda b: _order_blocks(b, length), "h long, sd long, spans array<int>"), "ordered")
    member = segments.select("h", "sd", "did", "start", "size")
    whole = member.join(often.filter("m > 1"), ["h", "sd"]).filter(F.col("size") >= length).select("did", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
    pair = F.explode(F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> struct(start + spans[2 * i] AS s, start + spans[2 * i + 1] AS e))"))
    part = member.join(single, ["h", "sd"]).select("did", pair.alias("p")).select("did", "p.s", "p.e")
    alone = classes.filter("copies = 1").select(F.col("rep").alias("did"))
    spans = written(whole.unionByName(part).join(alone, "did", "left_semi").groupBy("did").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    for x in (hits, shared, segments, often, single):
        forget(x)
    return texts, table.select("did", "doc_id", "sha", "n_bytes").join(classes.select("sha", "copies"), "sha", "left"), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether any byte goes) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes. Texts shorter than ``length`` lose nothing, longer ones with an identical copy
    lose all in one span; repeated rows are copies of each other. Cuts may fall inside a character. An empty table gives
    no rows.
    """
    texts, table, spans = repeated_spans(docs, length)
    few = spans.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    used = texts.select("did", "text")
    used = used.join(F.broadcast(spans.select("did")), "did", "left_semi") if few else used
    cut = used.join(spans, "did").select("did", "text", "spans").mapInArrow(_merged, "did long, n_removed long, n_spans long, kept_sha256 string")
    all_ = F.coalesce(F.col("copies") > 1, F.lit(False))
    out = table.join(cut, "did", "left").select(
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return out.withColumn("repeats", F.col("n_removed") > 0)


def op10(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
