"""Operator 2, a quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are hashed to ``VOCABULARY`` rows. Each row owns a sparse random index vector (two entries of +1 or -1 among
``WIDTH``); a word's vector is the sum of the index vectors of the words within two places of it, over all documents. So
the corpus pass hands on a table of fixed size. A document is the mean and spread of its words' vectors, frequent words
weighing less. The network is fitted with numpy on a bounded sample of labelled documents; a temperature found on a part
of that sample calibrates its probabilities. Labels of held-out documents are never read, and nothing but the text is an
input of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import crc_mod

VOCABULARY = 1 << 15
WIDTH = 32
REACH = 2
#: The fitting sample is bounded by this many labelled documents, the smallest by a hash of the id; ids are broadcast.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
#: Share of all words at which a word weighs half.
COMMON = 1e-3
FEATURES = 2 * WIDTH

_rng = np.random.default_rng(7)
_PLACES = np.stack([_rng.permuted(np.tile(np.arange(WIDTH), (VOCABULARY, 1)), axis=1)[:, k] for k in (0, 1)])
_SIGNS = _rng.choice([-1.0, 1.0], (2, VOCABULARY))


class Buckets(dict):
    """Row of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        k = self[word] = xxhash.xxh3_64_intdigest(word) % VOCABULARY
        return k


def rows_of(text: str | None, buckets: Buckets) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors (VOCABULARY x WIDTH) and pooling weights, from every text of ``docs``."""
    columns = [f"v{k}" for k in range(WIDTH)]

    def count(batches):
        sums, seen = np.zeros(VOCABULARY * WIDTH), np.zeros(VOCABULARY, np.int64)
        buckets, gap, waiting, size = Buckets(), np.full(REACH, -1), [], 0

        def add():
            ids = np.concatenate([gap, *waiting])
            seen[:] += np.bincount(ids[ids >= 0], minlength=VOCABULARY)
            for off in range(1, REACH + 1):
                a, b = ids[:-off], ids[off:]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for x, y in ((a, b), (b, a)):
                    for k in (0, 1):
                        sums[:] += np.bincount(x * WIDTH + _PLACES[k][y], weights=_SIGNS[k][y], minlength=VOCABULARY * WIDTH)
            waiting.clear()

        for batch in batches:
            for x in batch.column(0):
                ids = rows_of(x.as_py(), buckets)
                waiting += [ids, gap]
                size += len(ids)
                if size > 500_000:
                    add()
                    size = 0
        add()
        at = np.flatnonzero(seen)
        table = sums.reshape(VOCABULARY, WIDTH)[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), *(pa.array(table[:, k]) for k in range(WIDTH))], names=["row", "n", *columns])

    schema = "row long, n long, " + ", ".join(f"{c} long" for c in columns)
    sums = docs.select("text").mapInArrow(count, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", *columns)))
    found = sums.toPandas()  # at most VOCABULARY rows
    vectors, seen = np.zeros((VOCABULARY, WIDTH), np.float32), np.zeros(VOCABULARY)
    if len(found):
        vectors[found["row"]] = found[columns].to_numpy(np.float64)
        seen[found["row"]] = found["n"]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors, (COMMON / (COMMON + seen / max(seen.sum(), 1))).astype(np.float32)


def pooled(text: str | None, buckets: Buckets, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean and spread of a text's word vectors; zeros for a text without words."""
    ids = rows_of(text, buckets)
    if not len(ids):
        return np.zeros(FEATURES, np.float32)
    v, w = vectors[ids], weights[ids]
    w = w / w.sum()
    mean = w @ v
    return np.concatenate([mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))])


class Network:
    """Two layers; the temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.temperature = 1.0
        order = rng.permutation(len(x))
        cut = len(x) // 5
        self._fit(x[order[cut:]], y[order[cut:]], rng)
        if cut and 0 < y[order[:cut]].sum() < cut:
            self._calibrate(self.logits(x[order[:cut]]), y[order[:cut]])

    def _fit(self, x, y, rng):
        x = (x - self.mean) / self.scale
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, size = 0, 256
        for _ in range(max(EPOCHS, -(-2000 * size // max(len(x), 1)) if len(x) < 4000 else 0)):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                xb, yb = x[order[at : at + size]], y[order[at : at + size]]
                hidden = np.tanh(xb @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -40, 40))) - yb) / len(xb)
                back = np.outer(error, self.w2) * (1 - hidden**2)
                grads = [xb.T @ back + 1e-4 * self.w1, back.sum(axis=0), hidden.T @ error + 1e-4 * self.w2, np.array([error.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def _calibrate(self, logits, y):
        grid = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
        self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Constant:
    """Stands in where the labels have fewer than two classes: the smoothed share of label 1."""

    def __init__(self, y: np.ndarray):
        self.share = (y.sum() + 1) / (len(y) + 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _features(docs: DataFrame, table, keep: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def pool(batches):
        buckets = Buckets()
        vectors, weights = table.value
        for batch in batches:
            x = [pooled(t.as_py(), buckets, vectors, weights).astype(np.float32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.binary())], names=[*keep, "pooled"])

    return docs.mapInArrow(pool, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pooled binary"]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(word vectors as a broadcast, network) from all texts and the labels outside the held-out third.

    ``labels`` has doc_id and quality (0 or 1); null labels are left out and repeated ones count once, the smallest.
    """
    table = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(crc_mod(F.col("doc_id"), 3) != 1)
    known = known.groupBy(F.col("doc_id").alias("fit_id")).agg(F.min("quality").cast("double").alias("fit_label"))
    known = known.orderBy(F.xxhash64("fit_id"), "fit_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("fit_id")).select("fit_id", "fit_label", "text")
    found = sorted(_features(rows, table, ["fit_id", "fit_label"]).collect())  # at most ``sample`` documents
    y = np.array([r["fit_label"] for r in found])
    if not len(y) or y.min() == y.max():
        return table, Constant(y)
    return table, Network(np.stack([np.frombuffer(r["pooled"], np.float32) for r in found]).astype(np.float64), y)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts are scored like a text without words. Repeated rows get equal scores. An empty table gives no
    rows; without labels of both classes every score is the smoothed share of label 1.
    """
    docs = docs.select("doc_id", "text")
    table, model = fit(docs, labels, sample)

    def apply(batches):
        buckets = Buckets()
        vectors, weights = table.value
        for batch in batches:
            x = np.array([pooled(t.as_py(), buckets, vectors, weights) for t in batch.column(1)], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
