"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, lower-cased
(A-Z), without punctuation, hashed into ``2 ** BITS`` coordinates.  Each coordinate has
its own learning rate; L1 leaves most weights at zero, so the model that scores is a
short list of coordinates, bounded by the fit and small enough to send to every task.

The fit reads at most ``FIT_ROWS`` labelled rows (smallest hashes of doc_id, none of the
held-out fold); one task streams them, ``EPOCHS`` times.  Scores cover every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import NON_WORD, Words, binary_values, chunks, gram_hashes, mix, stage

BITS = 20
FIT_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
FOLDS = 5
BIAS_RATE = 0.05


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all texts (with repeats) and the text each belongs to."""
    words = Words(texts, lower=True, separators=NON_WORD)
    h = words.hashes()
    doc_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    values, owner = [h], [doc_of]
    for gap in (1, 2):  # neighbours, and one word skipped
        if len(h) > gap:
            same = doc_of[gap:] == doc_of[:-gap]
            values.append(mix(h[:-gap] * np.uint64(0x9FB21C651E98DF25) + h[gap:] + np.uint64(gap))[same])
            owner.append(doc_of[:-gap][same])
    return (np.concatenate(values) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is a plain adaptive step without L1."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + self.bias, -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= BIAS_RATE * g / np.sqrt(self.bias_n + 1e-12)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z) > L1)
        return at, self.weights(at), self.bias


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    model = Ftrl(bits)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.update(*rows[k])
    return model.sparse()


def score(texts: list[bytes], model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> np.ndarray:
    at, w, bias = model
    table = np.zeros(1 << bits)
    table[at] = w
    values, owner = features(texts, bits)
    hit = np.flatnonzero(table[values])
    pairs = np.unique(owner[hit] << bits | values[hit])
    logit = bias + np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _labelled(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in chunks(batch.column(1)):
            values, owner = features(binary_values(batch.column(1).slice(a, z - a)), bits)
            pairs = np.unique(owner << bits | values)
            cuts = np.searchsorted(pairs >> bits, np.arange(z - a + 1))
            own = (pairs & ((1 << bits) - 1)).astype(np.int32)
            rows = [own[cuts[i] : cuts[i + 1]] for i in range(z - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(2).slice(a, z - a).cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "at"])


def _train(batches: Iterator[pa.RecordBatch], epochs: int, bits: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += [(i, x.values.to_numpy(), y) for i, y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    at, w, bias = train([(x, y) for _, x, y in rows], epochs, bits)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], names=["at", "w"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most ``rows`` labelled documents outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter((fold != 0) & F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    found = stage(sample.mapInArrow(lambda b: _labelled(b, bits), "doc_id long, toxic int, at array<int>"), "toxic-fit")
    got = found.coalesce(1).mapInArrow(lambda b: _train(b, epochs, bits), "at long, w double").collect()
    if not got:
        return np.empty(0, dtype=np.int64), np.empty(0), 0.0
    at, w = np.array([r.at for r in got]), np.array([r.w for r in got])
    return at[at >= 0], w[at >= 0], float(w[at < 0][0])


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts score by the bias alone.  A null doc_id is held out (it can
    have no label).  Without labels every score is 0.5.  An empty table gives an empty
    result.
    """
    bits = options.get("bits", BITS)
    model = fit(docs, labels, **options)

    def judge(batches):
        for batch in batches:
            for a, z in chunks(batch.column(1)):
                ids, s = batch.column(0).slice(a, z - a), score(binary_values(batch.column(1).slice(a, z - a)), model, bits)
                out = pa.array([i is None or held_out(i) for i in ids.to_pylist()])
                yield pa.RecordBatch.from_arrays([ids, out, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
