"""Operator 6, LM scoring: a weighted backoff automaton over smoothed n-grams of the corpus.

States are histories: the empty one, the start of a text, every word and every pair of words that training has at least
twice as a history. From state h an arc for each word w that followed h in training weighs log10 of
P(w | h) = l(h) c(hw) / c(h) + (1 - l(h)) P(w | h'), where h' is h without its first word, l(h) = (c(h) - 1) / (c(h) - 1 +
``DOUBT``), and P(w) = (c(w) + 1) / (N + V + 1) at the empty history. It leads to the longest history that ends in w. Any other
word takes the failure arc, log10(1 - l(h)), to h' and is tried there. So each state's probabilities add up to 1. One
left-to-right traversal of a text carries the state and adds up the weights.

The model grows with the corpus, so no task holds it whole. Documents are dealt to blocks; a block asks, once for each
distinct n-gram it has, the shard that owns the n-gram's hash, and hands on its own training counts with the request. A
shard adds the counts of all blocks and answers each block in the order of its request; N and V add up over shards. The block then builds just the
part of the automaton that its texts can reach. A frequent n-gram is asked once per block, so no key is hot. Requests go
only to shards that a block needs, so there are never more rows than n-grams; hashes are sorted and packed as differences.

Words are told apart by 64 bits. Longer n-grams are told apart by 40 bits and their shard's; as shards grow in number with
the input, that leaves about one in 500,000 n-grams with a count that isn't its own at any size. The base score has words only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_mod, parts_for

DOUBT = 4.0
#: MB of input for a block of documents.
BLOCK_MB = 8
#: Shards are at most 2 to this power: a block sends each a row.
MOST_BITS = 17
#: Tokens for which a part of the automaton is built at a time.
AT_A_TIME = 200_000
END, START = 0, 1
_FIXED = np.array([xxhash.xxh3_64_intdigest(b"\0 end"), xxhash.xxh3_64_intdigest(b"\0 start")], np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first words and their last word."""
    h = left * np.uint64(0x9E3779B97F4A7C15) ^ right
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


class BlockTokens:
    """Tokens of a block's texts, and its distinct n-grams of each order: hashes in order, training counts, and which one ends at each token.

    ``grams[k]`` are runs of k + 1 tokens. A text begins with START; its first token is the second of a pair, and no run of three ends there.
    """

    def __init__(self, texts: list, train: np.ndarray):
        numbers: dict[bytes, int] = {b"\0 end": END, b"\0 start": START}
        parts, self.sizes = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
            parts.append(np.array([END], np.int32))
            self.sizes[i] = len(words) + 1
        token = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        word[:2] = _FIXED
        self.trained = np.repeat(train, self.sizes)
        hashed = word[token]
        before = np.roll(hashed, 1)
        before[self.starts] = _FIXED[START]
        pair = _joined(before, hashed)
        three = _joined(np.roll(pair, 1), hashed)
        three[self.starts] = 0  # there is none
        self.grams = [self._distinct(h) for h in (hashed, pair, three)]

    def _distinct(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, at = np.unique(h, return_inverse=True)
        return known, np.bincount(at, weights=self.trained, minlength=len(known)).astype(np.uint32), at.astype(np.int32)


def _cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where the sorted hashes pass from each shard to the next; a shard is the top ``bits`` of a hash."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: the high bytes are mostly zero, which compresses away."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(packed), dtype=np.uint64)


def _low(hashes: np.ndarray, bits: int) -> np.ndarray:
    """40 bits below the shard's; they keep the order within a shard."""
    return hashes << np.uint64(bits) >> np.uint64(24)


ORDERS = ("words", "pairs", "threes")
REQUEST = "shard int, block long, " + ", ".join(f"{x} binary, {x}_counts binary" for x in ORDERS)
ANSWER = "block long, shard int, " + ", ".join(f"{x} binary" for x in ORDERS) + ", tokens long, types long"


def _texts(table: pa.Table) -> tuple[list, np.ndarray]:
    """Texts in a fixed order, with whether they are learnt from."""
    return table.column("text").to_pylist(), ~table.column("held_out").to_numpy()


def _request(bits: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = BlockTokens(*_texts(table))
        hashes = [b.grams[0][0], *(_low(g[0], bits) for g in b.grams[1:])]
        cuts = [_cuts(g[0], bits) for g in b.grams]
        shards = np.flatnonzero(sum(np.diff(c) for c in cuts))
        columns = [pa.array(shards.astype(np.int32)), pa.array([key[0].as_py()] * len(shards), pa.int64())]
        for h, (_, counts, _), cut in zip(hashes, b.grams, cuts, strict=True):
            columns.append(pa.array([_packed(h[cut[s] : cut[s + 1]]) for s in shards], pa.binary()))
            columns.append(pa.array([counts[cut[s] : cut[s + 1]].tobytes() for s in shards], pa.binary()))
        return pa.table(columns, names=["shard", "block", *(x + y for x in ORDERS for y in ("", "_counts"))])

    return ask


def _sums(hashes: list[np.ndarray], counts: list[bytes]) -> tuple[list[bytes], int, int]:
    """For each block what other blocks add to its counts, in the order it asked; the tokens and the types counted."""
    h, own = np.concatenate(hashes), np.frombuffer(b"".join(counts), np.uint32)
    known, at = np.unique(h, return_inverse=True)
    total = np.bincount(at, weights=own, minlength=len(known)).astype(np.uint64)
    ends = np.cumsum([len(x) for x in hashes])
    return [_planes(x) for x in np.split(total[at] - own, ends[:-1])], int(total.sum()), int((total > 0).sum())


def _answer(table: pa.Table) -> pa.Table:
    """What a shard knows, for each block; in its first row also how many tokens and types of its words are in training."""
    columns = [table.column("block"), table.column("shard")]
    for x in ORDERS:
        added, n, v = _sums([_unpacked(y) for y in table.column(x).to_pylist()], table.column(x + "_counts").to_pylist())
        columns.append(pa.array(added, pa.binary()))
        tokens, types = (n, v) if x == "words" else (tokens, types)
    rest = [0] * (table.num_rows - 1)
    columns += [pa.array([tokens, *rest], pa.int64()), pa.array([types, *rest], pa.int64())]
    return pa.table(columns, names=["block", "shard", *ORDERS, "tokens", "types"])


class Automaton:
    """The states and arcs that some texts can reach, by the counts of the n-grams that end at each of their tokens.

    ``arc[k][t]`` is the arc of token t out of the state that holds the k words before it, -1 if there is none; every state has
    an order, the number of its words. ``weight`` and ``leads_to`` (the order of the state it leads to) are by arc, ``fails``
    (weight of the failure arc) is by the token whose history the state holds.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, threes: np.ndarray, starts: np.ndarray, texts: int, n: int, v: int, doubt: float):
        one, two = np.roll(words, 1), np.roll(pairs, 1)
        one[starts], two[starts] = texts, 0  # the history of a text's first token is START
        p = (words + 1) / (n + v + 1)
        self.known, self.base = words > 0, np.log10(p)
        longest = np.where(pairs >= 2, 2, np.where(words >= 2, 1, 0))
        arcs, weights, leads, self.fails = [np.arange(len(words), dtype=np.int32)], [self.base], [np.minimum(longest, 1).astype(np.int8)], [None]
        for gram, history in ((pairs, one), (threes, two)):
            there = (gram > 0) & (history >= 2)
            seen = np.maximum(history, 1)
            trust = (seen - 1) / (seen - 1 + doubt)
            p = trust * np.where(there, gram, 0) / seen + (1 - trust) * p
            at = np.full(len(words), -1, np.int32)
            at[there] = sum(map(len, weights)) + np.arange(np.count_nonzero(there))
            arcs.append(at)
            weights.append(np.log10(p[there]))
            leads.append(longest[there].astype(np.int8))
            self.fails.append(np.log10(1 - trust))
        self.arc, self.weight, self.leads_to = arcs, np.concatenate(weights), np.concatenate(leads)
        self.start = 1 if texts >= 2 else 0

    def traverse(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text: from the start state, an arc for each token, after failure arcs where it has none."""
        out = []
        for begin, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            text = slice(begin, begin + size)
            arcs = [x[text] for x in self.arc]
            there = [(a >= 0).tolist() for a in arcs]  # whether each token has an arc out of the state of each order
            weight, leads_to = [self.weight[a].tolist() for a in arcs], [self.leads_to[a].tolist() for a in arcs]
            fails = [x if x is None else x[text].tolist() for x in self.fails]
            total, state = 0.0, self.start
            for t in range(size):
                while not there[state][t]:
                    total += fails[state][t]
                    state -= 1
                total += weight[state][t]
                state = leads_to[state][t]
            out.append(total)
        return np.array(out)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_per_token double"


def _score(doubt: float):
    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = BlockTokens(*_texts(table))
        answers = answers.sort_by("shard")
        n, v = answers.column("all_tokens")[0].as_py(), answers.column("all_types")[0].as_py()
        counts = [np.concatenate([_from_planes(y) for y in answers.column(x).to_pylist()]) + g[1] for x, g in zip(ORDERS, b.grams, strict=True)]
        texts = int(counts[0][np.searchsorted(b.grams[0][0], _FIXED[END])]) if len(b.sizes) else 0
        at = [g[2] for g in b.grams]
        known, base, total = (np.empty(len(b.sizes), x) for x in (np.int64, np.float64, np.float64))
        for some in np.split(np.arange(len(b.sizes)), np.flatnonzero(np.diff(b.starts // AT_A_TIME)) + 1):
            if not len(some):
                continue
            begin, end = b.starts[some[0]], b.starts[some[-1]] + b.sizes[some[-1]]
            starts = b.starts[some] - begin
            automaton = Automaton(*(c[x[begin:end]].astype(np.float64) for c, x in zip(counts, at, strict=True)), starts, texts, n, v, doubt)
            known[some] = np.add.reduceat(automaton.known.astype(np.int64), starts)
            base[some] = np.add.reduceat(automaton.base, starts)
            total[some] = automaton.traverse(starts, b.sizes[some])
        columns = [
            table.column("doc_id"), table.column("held_out"), pa.array(b.sizes), pa.array(known),
            pa.array(np.full(len(b.sizes), n)), pa.array(base), pa.array(total), pa.array(total / np.maximum(b.sizes, 1)),
        ]
        return pa.table(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    return score


def lm_scores(docs: DataFrame, fold: int = 2, folds: int = 7, doubt: float = DOUBT) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learnt from those whose crc32(doc_id) mod ``folds`` isn't ``fold``.

    Null and empty texts are one end token. Repeated rows are counted and scored each. An empty table gives no rows; with
    no training rows N and V are 0, so every token has probability 1.
    """
    blocks = parts_for(docs, BLOCK_MB)
    bits = min(MOST_BITS, max(0, (blocks - 1).bit_length()))
    dealt = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), folds) == fold).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    asked = dealt.groupBy("block").applyInArrow(_request(bits), REQUEST)
    answers = asked.groupBy("shard").applyInArrow(_answer, ANSWER)
    whole = answers.agg(F.sum("tokens").alias("all_tokens"), F.sum("types").alias("all_types"))  # one row
    answers = answers.withColumn("all", F.lit(0)).join(F.broadcast(whole.withColumn("all", F.lit(0))), "all").select("block", "shard", *ORDERS, "all_tokens", "all_types")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(doubt), SCORED)


def op6(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
