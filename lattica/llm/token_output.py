"""Operator 7, token ids in a compressed binary format.

Texts become token ids with a public tokenizer, an end id after each document. The ids are written in ascending doc_id
order as frames. A frame holds whole documents: their ids and lengths, and the token ids cut to blocks of ``BLOCK`` that
are coded independently, each with its own fresh model and a checksum.

The model mixes three orders into one distribution of the whole next id. Order 2 (two ids back) and order 1 each predict one
id, from hashed tables that a block fills as it goes; order 0 gives every id of the frame a chance, by counts of classes
of ids that adapt in the block times the id's share of its class in the frame. The mix is w2 [x = g2] + w1 [x = g1] + w0 P0(x),
with weights that adapt for each pair of confidences. Its running sum has a closed form, so a range coder with 60-bit bounds
and 20-bit digits takes an id in one step. All blocks of a frame are coded side by side, one id of each block per step, so the arithmetic
runs on arrays.

Frames are rows of a binary column that Spark writes and reads, so any store that Spark can reach will do.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import parts_for, shared_dir

#: Ids per block, and blocks per frame.
BLOCK = 4096
FRAME_BLOCKS = 1536
#: Words of which a worker remembers the ids.
REMEMBERED = 500_000
MAGIC = b"LTOK"
VERSION = 2

_SLOT_BITS = 10
_SLOTS = 1 << _SLOT_BITS
#: Bits of the weights, of classes of ids, and of ids in their class; one id's interval is a part of 2**34.
_MIX_BITS, _CLASS_BITS, _INNER_BITS = 10, 10, 14
_ID_BITS = _CLASS_BITS + _INNER_BITS
_CLASSES = 64
#: Bits of a digit and of the bounds; a span is at least _FLOOR when an id is coded.
_DIGIT, _WIDTH = 20, 60
_FLOOR = 1 << (_WIDTH - _DIGIT)
#: Ids after which the class counts of a block take effect, and what the frame's counts weigh at its start.
_RENEW, _START = 128, 300


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of texts, word by word: before a space that a visible character follows, the tokenizer always cuts."""

    _odd = re.compile(r" (?=\s|\Z)")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(names.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self._clear()

    def _clear(self):
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        self.n, self.used = 2, 1  # entry 0 is the end id, 0; entry 1 has no ids
        self.size[1] = 0

    def _learn(self, known: dict[str, int], words: list[str], lead: str):
        new = [w for w in words if w not in known]
        if not new:
            return
        if lead:  # one text for many words: no word holds a space, so a new word begins where an id does
            runs = [lead + lead.join(new[i : i + 100]) for i in range(0, len(new), 100)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
            sizes = np.diff(np.concatenate([np.flatnonzero(self.opens[ids]), [len(ids)]]))
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(new) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.n : self.n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(new)] = sizes
        known.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)
        self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        if self.n > REMEMBERED:
            self._clear()
        if not texts:
            return []
        odd = [i for i, t in enumerate(texts) if self._odd.search(t)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        lists = pc.split_pattern(pa.array(plain, pa.string()), " ")
        edges, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")
        names = joined[0].as_py().split(" ")  # words hold no spaces
        inner = np.ones(len(which), bool)
        inner[edges[:-1]] = False
        later = np.flatnonzero(np.bincount(which[inner], minlength=len(names)))
        after = list(map(names.__getitem__, later.tolist()))
        self._learn(self.later, after, " ")
        heads = [names[i] for i in which[edges[:-1]].tolist()]
        self._learn(self.first, list({h for h in heads if h}), "")
        entry = np.ones(len(names), np.int64)
        entry[later] = list(map(self.later.__getitem__, after))
        k = entry[which]
        k[edges[:-1]] = [self.first[h] if h else 1 for h in heads]
        stop = edges[1:] + np.arange(len(texts))  # where each text's end id goes
        held = np.zeros(len(k) + len(texts), np.int64)
        held[np.delete(np.arange(len(held)), stop)] = k
        size = self.size[held]
        ends = np.cumsum(size)
        out = np.split(self.flat[np.repeat(self.at[held] - ends + size, size) + np.arange(ends[-1])], ends[stop][:-1])
        for i in odd:
            out[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, 0], np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- coder


class Frequencies:
    """The ids of a frame and their counts: what order 0 knows when a block begins.

    Ids stand for their place among the frame's ids (symbols). Runs of symbols are classes of at most about 1 / 32 of the
    counts and of the symbols.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids.astype(np.int64), counts.astype(np.int64)
        n, total = len(ids), int(self.counts.sum())
        middle = np.cumsum(self.counts) * 2 - self.counts
        place = middle * _CLASSES // (4 * total) + (2 * np.arange(n) + 1) * _CLASSES // (4 * n)
        self.of = np.unique(place, return_inverse=True)[1].astype(np.int64)
        self.weight = np.bincount(self.of, self.counts).astype(np.int64)
        m = np.bincount(self.of)
        room = (1 << _INNER_BITS) - m
        self.size = 1 + self.counts * room[self.of] // self.weight[self.of]
        first = np.cumsum(m) - m
        self.size[first] += (1 << _INNER_BITS) - np.bincount(self.of, self.size).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size - (self.of << _INNER_BITS)
        self.inverse = np.repeat(np.arange(n, dtype=np.uint16), self.size)

    @classmethod
    def counted(cls, ids: np.ndarray) -> Frequencies:
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        return cls(known, counts[known])

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        at = np.zeros(int(self.ids[-1]) + 1, np.uint16)
        at[self.ids] = np.arange(len(self.ids))
        return at[ids]


class _Model:
    """The adaptive model of many blocks, one lane each. A table entry is a predicted symbol and two bits of confidence."""

    def __init__(self, lanes: int, known: Frequencies):
        self.known, self.lane = known, np.arange(lanes)
        self.at = self.lane * _SLOTS
        self.table = [np.zeros(lanes * _SLOTS, np.int32) for _ in range(2)]
        self.trust = [np.tile(np.array(t, np.int32), lanes) for t in ([6000] * 4 + [20000] * 4 + [45000] * 4 + [58000] * 4, [3000, 12000, 30000, 45000] * 4)]
        self.classes = len(known.weight)
        self.seen = np.tile(_START * known.weight // int(known.weight.sum()), (lanes, 1)) * 16 + 1
        self.past = [np.zeros(lanes, np.int64) for _ in range(2)]
        self.edges = np.zeros((lanes, self.classes + 1), np.int64)
        self.steps = 0
        self._renew()

    def _renew(self):
        share = (1 << _CLASS_BITS) - self.classes
        np.cumsum(1 + self.seen * share // self.seen.sum(axis=1, keepdims=True), axis=1, out=self.edges[:, 1:])
        self.edges[:, self.classes] = 1 << _CLASS_BITS
        self.row = self.lane * (self.classes + 1)
        self.class_of = None

    def look(self, n: int):
        """Predictions of the first ``n`` lanes, order 2 and order 1, and the weights of the three orders."""
        mask = _SLOTS - 1
        one = self.past[0][:n] * 40503
        two = (self.past[1][:n] * 2246822519 ^ one * 65599) >> 11
        self.i = [self.at[:n] + (two & mask), self.at[:n] + (one >> 3 & mask)]
        self.entry = [self.table[k][self.i[k]] for k in (0, 1)]
        self.guess = [e >> 2 for e in self.entry]
        self.sure = [e & 3 for e in self.entry]
        self.context = self.lane[:n] * 16 + (self.sure[0] << 2 | self.sure[1])
        self.odds = [self.trust[k][self.context] for k in (0, 1)]
        w2 = 1 + (self.odds[0] * 1020 >> 16)
        w1 = (1022 - w2) * (self.odds[1] >> 6) >> 10
        self.weights = w2.astype(np.int64), w1.astype(np.int64), (1024 - w2 - w1).astype(np.int64)

    def below(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the interval of symbols ``x`` in 2**34, under the mix of all orders."""
        k, (w2, w1, w0) = self.known, self.weights
        at = self.row[:n] + k.of[x]
        edge = self.edges.ravel()
        first = edge[at]
        width = edge[at + 1] - first
        g2, g1 = self.guess
        start = w0 * ((first << _INNER_BITS) + k.start[x] * width) + ((w2 * (g2 < x) + w1 * (g1 < x)) << _ID_BITS)
        size = w0 * (k.size[x] * width) + ((w2 * (g2 == x) + w1 * (g1 == x)) << _ID_BITS)
        return start, size

    def symbol_at(self, v: np.ndarray, n: int) -> np.ndarray:
        """The symbols whose intervals hold ``v``."""
        (w2, w1, w0), k = self.weights, self.known
        if self.class_of is None:
            lanes = len(self.lane)
            self.class_of = np.repeat(np.tile(np.arange(self.classes, dtype=np.uint8), lanes), np.diff(self.edges, axis=1).ravel())
        found, over = np.full(n, -1), 0
        for g, w in zip(self.guess, (w2, w1), strict=True):
            start, size = self.below(g, n)
            after = v >= start + size
            over = over + w * after
            here = (v >= start) & ~after
            found = np.where(here, g, found)
        e = np.flatnonzero(found < 0)
        y = (v[e] - (over[e] << _ID_BITS)) // w0[e]
        c = self.class_of[(self.lane[e] << _CLASS_BITS) + (y >> _INNER_BITS)].astype(np.int64)
        at = self.row[e] + c
        edge = self.edges.ravel()
        first = edge[at]
        inner = (y - (first << _INNER_BITS)) // (edge[at + 1] - first)
        found[e] = k.inverse[(c << _INNER_BITS) + inner]
        return found

    def learn(self, n: int, x: np.ndarray):
        fresh, missed = (x << 2).astype(np.int32), True
        for k in (0, 1):
            e, c, odds = self.entry[k], self.sure[k], self.odds[k]
            hit = self.guess[k] == x
            self.table[k][self.i[k]] = np.where(hit, e + (c < 3), np.where(c > 0, e - 1, fresh))
            # order 1 is held to account only where order 2 was wrong
            self.trust[k][self.context] = odds + (((hit.astype(np.int32) << 16) - odds) * missed >> 5)
            missed = ~hit
        self.seen.ravel()[self.lane[:n] * self.classes + self.known.of[x]] += 16
        self.past[1], self.past[0] = self.past[0], x
        self.steps += 1
        if self.steps % _RENEW == 0:
            self._renew()


def _packed(digits: np.ndarray) -> bytes:
    """Digits of 20 bits as bytes; zeros at the end are left out."""
    d = np.concatenate([digits, np.zeros(len(digits) % 2, np.int64)])
    return (d[0::2] << _DIGIT | d[1::2]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().rstrip(b"\0")


def _unpacked(block: bytes, n: int) -> np.ndarray:
    raw = np.zeros((-(-n // 2), 8), np.uint8)
    raw[:, 3:] = np.frombuffer(block.ljust(5 * len(raw), b"\0"), np.uint8).reshape(-1, 5)
    v = raw.view(">u8").ravel().astype(np.int64)
    return np.stack([v >> _DIGIT, v & ((1 << _DIGIT) - 1)], axis=1).ravel()[:n]


def encode_blocks(ids: np.ndarray, known: Frequencies | None = None) -> list[bytes]:
    """The ids in blocks of BLOCK, each coded on its own, from the counts ``known`` on (those of ``ids`` if none are given).

    A bound may outgrow its bits while coding; the digit before it takes the carry, and carries move up at the end.
    """
    lanes = -(-len(ids) // BLOCK)
    if not lanes:
        return []
    if int(ids.max()) >= 1 << 16:
        raise ValueError("ids need more than 16 bits")
    known = known or Frequencies.counted(ids)
    last = len(ids) - (lanes - 1) * BLOCK
    steps = np.ascontiguousarray(np.concatenate([known.symbols(ids), np.zeros(lanes * BLOCK - len(ids), np.uint16)]).reshape(lanes, BLOCK).T)
    model = _Model(lanes, known)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, (1 << _WIDTH) - 1, np.int64)
    out, size = np.zeros((lanes, 2 * BLOCK + 8), np.int32), np.zeros(lanes, np.int64)
    for t in range(BLOCK if lanes > 1 else last):
        n = lanes if t < last else lanes - 1
        x = steps[t, :n].astype(np.int64)
        model.look(n)
        start, part = model.below(x, n)
        unit = span[:n] >> (_MIX_BITS + _ID_BITS)
        low[:n] += start * unit
        span[:n] = part * unit
        go = np.flatnonzero(span[:n] < _FLOOR)
        while len(go):
            lo, sp, k = low[go], span[go] << _DIGIT, size[go]
            out[go, k] = lo >> (_WIDTH - _DIGIT)
            size[go] = k + 1
            low[go], span[go] = (lo & (_FLOOR - 1)) << _DIGIT, sp
            go = go[sp < _FLOOR]
        model.learn(n, x)
    out[model.lane, size] = (low + _FLOOR - 1) >> (_WIDTH - _DIGIT)  # one digit tells the block's end: zeros may follow it
    size += 1
    for k in range(int(size.max()) - 1, 0, -1):
        out[:, k - 1] += out[:, k] >> _DIGIT
    out &= (1 << _DIGIT) - 1
    return [_packed(out[i, : size[i]].astype(np.int64)) for i in range(lanes)]


def decode_blocks(blocks: list[bytes], total: int, known: Frequencies | None) -> np.ndarray:
    """The ids of blocks that :func:`encode_blocks` made with the same counts."""
    lanes = len(blocks)
    if not lanes:
        return np.empty(0, np.uint32)
    last = total - (lanes - 1) * BLOCK
    longest = max(map(len, blocks)) * 2 // 5 + 8
    digits = np.stack([_unpacked(b, longest) for b in blocks])
    digits = np.concatenate([digits, np.zeros((lanes, 8), np.int64)], axis=1)
    model = _Model(lanes, known)
    span = np.full(lanes, (1 << _WIDTH) - 1, np.int64)
    code = digits[:, 0] << 2 * _DIGIT | digits[:, 1] << _DIGIT | digits[:, 2]
    at = np.full(lanes, 3)
    ids = np.zeros((BLOCK, lanes), np.uint16)
    most = (1 << (_MIX_BITS + _ID_BITS)) - 1
    for t in range(BLOCK if lanes > 1 else last):
        n = lanes if t < last else lanes - 1
        model.look(n)
        unit = span[:n] >> (_MIX_BITS + _ID_BITS)
        x = model.symbol_at(np.minimum(code[:n] // unit, most), n)
        start, part = model.below(x, n)
        code[:n] -= start * unit
        span[:n] = part * unit
        go = np.flatnonzero(span[:n] < _FLOOR)
        while len(go):
            sp, k = span[go] << _DIGIT, np.minimum(at[go], digits.shape[1] - 1)  # a damaged block may ask for more
            code[go], span[go], at[go] = code[go] << _DIGIT | digits[go, k], sp, k + 1
            go = go[sp < _FLOOR]
        ids[t, :n] = x
        model.learn(n, x)
    found = ids.T.ravel()[:total] if lanes > 1 else ids[:total, 0]
    return known.ids.astype(np.uint32)[found]


# ---------------------------------------------------------------- frames


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One frame: header, doc ids, lengths and counts of token ids, block sizes and checksums, blocks."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    model = Frequencies.counted(ids) if len(ids) else None
    blocks = encode_blocks(ids, model)
    counts = np.concatenate([[len(model.ids)], model.ids, model.counts]).astype("<u4").tobytes() if model else b""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(d) for d in docs], "<u4")
    head = zlib.compress(known.tobytes() + keys.tobytes() + lengths.tobytes() + counts, 6)
    sums = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(len(blocks))]
    sizes = np.array([[len(b), c] for b, c in zip(blocks, sums, strict=True)], "<u4").reshape(-1, 2)
    return struct.pack("<4sHIQII", MAGIC, VERSION, len(docs), len(ids), len(blocks), len(head)) + head + sizes.tobytes() + b"".join(blocks)


def unpack(frame: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """What :func:`pack` was given; raises ValueError if a checksum doesn't hold."""
    fixed = struct.calcsize("<4sHIQII")
    magic, version, n, total, count, head = struct.unpack("<4sHIQII", frame[:fixed])
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of this format")
    table = zlib.decompress(frame[fixed : fixed + head])
    known, keys, lengths = np.frombuffer(table, np.uint8, n), np.frombuffer(table, "<i8", n, n), np.frombuffer(table, "<u4", n, 9 * n)
    at = fixed + head + 8 * count
    sizes = np.frombuffer(frame, "<u4", 2 * count, fixed + head).reshape(-1, 2)
    blocks = []
    for size in sizes[:, 0].tolist():
        blocks.append(frame[at : at + size])
        at += size
    counts = np.frombuffer(table, "<u4", -1, 13 * n) if total else []
    model = Frequencies(*counts[1:].reshape(2, -1)) if total else None
    ids = decode_blocks(blocks, total, model)
    for i, crc in enumerate(sizes[:, 1].tolist()):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return [k if ok else None for k, ok in zip(keys.tolist(), known.tolist(), strict=True)], np.split(ids, np.cumsum(lengths)[:-1]) if n else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the frames of ``docs`` (doc_id, text) to ``path``, in ascending doc_id order, null ids first.

    Ranges of doc_id are tasks; each task codes frame after frame, so memory is bounded by a frame or a single document.
    Null texts are empty and have just the end id. Repeated rows are written each, by doc_id then text. An empty table
    writes no frames.
    """

    def code(batches):
        tokens, held, keys, size, frame = encoder(tokenizer), [], [], 0, 0
        where = TaskContext.get().partitionId()

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([where], pa.int64()), pa.array([frame], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(keys, held)], pa.binary())],
                names=["part", "frame", "n_tokens", "payload"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for key, ids in zip(piece.column("doc_id").to_pylist(), tokens.encode(piece.column("text").to_pylist()), strict=True):
                    held.append(ids)
                    keys.append(key)
                    size += len(ids)
                    if size >= BLOCK * FRAME_BLOCKS:
                        yield row()
                        held, keys, size, frame = [], [], 0, frame + 1
        if held:
            yield row()

    text = F.coalesce("text", F.lit(""))
    ranged = docs.select("doc_id", text.alias("text")).repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    frames = ranged.mapInArrow(code, "part long, frame long, n_tokens long, payload binary")
    frames.write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents of written frames and the frames' places: part, frame, doc_id, offset (in the frame), n_tokens, ids
    (little-endian unsigned 32-bit), and part, frame, begin (ids in all frames before)."""
    frames = spark.read.parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = frames.select("part", "frame", inside.alias("inside")).join(before, "part").select("part", "frame", (F.col("first") + F.col("inside")).alias("begin"))

    def decode(batches):
        for batch in batches:
            for part, frame, payload in zip(*(batch.column(c) for c in ("part", "frame", "payload")), strict=True):
                keys, docs = unpack(payload.as_py())
                sizes = np.array([len(d) for d in docs], np.int64)
                m = len(docs)
                for at in range(0, m, 1000):
                    cut = slice(at, at + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.as_py()] * len(docs[cut]), pa.int64()),
                            pa.array([frame.as_py()] * len(docs[cut]), pa.int64()),
                            pa.array(keys[cut], pa.int64()),
                            pa.array((np.cumsum(sizes) - sizes)[cut]),
                            pa.array(sizes[cut]),
                            pa.array([d.astype("<u4").tobytes() for d in docs[cut]], pa.binary()),
                        ],
                        names=["part", "frame", "doc_id", "offset", "n_tokens", "ids"],
                    )

    rows = frames.select("part", "frame", "payload").mapInArrow(decode, "part long, frame long, doc_id long, offset long, n_tokens long, ids binary")
    return rows, starts


def digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows, starts = read_tokens(spark, path)
    short = rows.select("part", "frame", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return short.join(starts, ["part", "frame"]).select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files (below the shared folder unless ``path`` is given) and read back their digests."""
    import uuid

    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = path or f"{shared_dir(spark)}/lattica/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return digests(spark, path)


def op7(spark, sf_dir: str) -> DataFrame:
    return encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
