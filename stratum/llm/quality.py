"""Quality rules: an isolation forest over rule statistics, threshold from labelled rows.

Every tree is grown on all labelled rows that pass the base rules, none is left out: each
level's cuts are drawn between the least and the greatest value of all rows in a node.
Trees are as deep as for ``TREE_ROWS`` rows, and the size of a leaf is its share of all rows
times ``TREE_ROWS``.  A document's score is the usual
``2 ** (-mean path length / c(TREE_ROWS))``.  Ratios of short texts are noisy, so
each is shrunk towards the median of all labelled rows as if ``PRIOR_WORDS`` usual words
were added.  Thresholds, one per length band, are the lowest that keep at least
``KEEP_GOOD`` of all rows labelled good in that band.
Medians and thresholds are exact: value ranges are narrowed by counts, so the driver gets
``CELLS`` counts a range, and one range a node and feature, whatever the corpus.
Texts are never shuffled; their statistics meet the labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Words, binary_values, chunks, gram_hashes, stage, unstage

TREES = 200
TREE_ROWS = 64
KEEP_GOOD = 0.998
WINDOW = 8
PRIOR_WORDS = 30.0
BANDS = (60, 200)
CELLS = 2_048
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_ASCII = np.zeros((256, 3), dtype=np.int64)  # symbols, upper case, code point starts
_ASCII[list(SYMBOLS), 0] = 1
_ASCII[65:91, 1] = 1
_ASCII[[b for b in range(256) if not 0x80 <= b < 0xC0], 2] = 1


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and features."""
    n = len(texts)
    words = Words(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    counts = np.stack([_sums(_ASCII[words.data, k], bounds) for k in range(3)], axis=1)
    n_words = np.diff(words.first)
    space = np.zeros(256, dtype=np.int64)
    space[[9, 10, 11, 12, 13, 32]] = 1
    spaces = _sums(space[words.data], bounds)
    word_chars = counts[:, 2] - spaces
    repeat = np.zeros(n, dtype=np.int64)
    distinct = np.zeros(n, dtype=np.int64)
    h = words.hashes()
    if len(h):
        doc_of = np.repeat(np.arange(n), n_words)
        order = np.lexsort((h, doc_of))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc_of[order][1:] != doc_of[order][:-1])
        distinct = np.bincount(doc_of[order][new], minlength=n)
    g, g2 = gram_hashes(h, WINDOW), gram_hashes(words.hashes(1), WINDOW, 1)
    if len(g):
        doc_of_gram = doc_of[: len(g)]
        inside = doc_of[WINDOW - 1 :] == doc_of_gram
        at = np.flatnonzero(inside)
        order = np.lexsort((g2[at], g[at], doc_of_gram[at]))
        at = at[order]
        same = np.zeros(len(at), dtype=bool)
        if len(at) > 1:
            pair = (g[at][1:] == g[at][:-1]) & (g2[at][1:] == g2[at][:-1]) & (doc_of_gram[at][1:] == doc_of_gram[at][:-1])
            same[1:] |= pair
            same[:-1] |= pair
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, at[same], 1)
        np.add.at(cover, at[same] + WINDOW, -1)
        repeat = np.bincount(doc_of[np.cumsum(cover)[:-1] > 0], minlength=n)
    lines = np.array([_dup_lines(t) for t in texts], dtype=np.int64)
    base = np.stack([n_words, word_chars, counts[:, 0], lines, repeat], axis=1).astype(np.int64)
    w, c = np.maximum(n_words, 1), np.maximum(counts[:, 2], 1)
    features = np.stack([
        np.minimum(counts[:, 0] / w, 3.0),
        counts[:, 1] / c,
        # distinct words against what prose of that length has (Heaps' law)
        distinct / np.power(w, 0.75),
    ], axis=1)
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n keys; n need not be whole."""
    if n <= 1:
        return 0.0
    x = n + 5.0  # harmonic number of n - 1 from that of n + 5
    harmonic = math.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4) - sum(1 / (n - 1 + k) for k in range(1, 7))
    return 2.0 * harmonic - 2.0 * (n - 1) / n


class IsolationForest:
    """Random axis-parallel splits, stored as flat arrays (a few hundred kB, whatever the corpus).

    ``open`` makes each tree one leaf.  ``split`` adds a level from the ranges of all rows in
    each leaf; ``spans`` has those of some rows, and parts combine by minimum and maximum.
    ``weigh`` sets the path lengths from the rows in each leaf.
    """

    def __init__(self, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 13):
        self.trees, self.rows, self.seed = trees, rows, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def shrunk(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        w = words[:, None].astype(float)
        return (w * x + PRIOR_WORDS * self.center) / (w + PRIOR_WORDS)

    def fit(self, x: np.ndarray, words: np.ndarray) -> IsolationForest:
        self.open(len(x), np.median(x, axis=0))
        while self.level < self.depth:
            self.split(*self.spans(x, words))
        return self.weigh(self.leaf_counts(x, words))

    def open(self, n: int, center: np.ndarray) -> IsolationForest:
        """Trees without splits, for n rows in all."""
        self.center = center
        self.size = size = min(self.rows, n)
        self.norm = max(average_path(size), 1.0)
        self.level, self.depth = 0, max(1, math.ceil(math.log2(max(size, 2))))
        self.nodes = [(np.array([-1]), np.zeros(1), np.zeros(1, dtype=int), np.zeros(1, dtype=int), np.zeros(1)) for _ in range(self.trees)]
        return self

    def spans(self, x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each feature in each node that is a leaf, all trees after one another."""
        values, base = np.ascontiguousarray(self.shrunk(x, words).T), 0
        lo = np.full((len(values), sum(len(n[0]) for n in self.nodes)), math.inf)
        hi = -lo
        for at, nodes in zip(self.leaves(x, words), self.nodes, strict=True):
            for k, v in enumerate(values):
                np.minimum.at(lo[k], base + at, v)
                np.maximum.at(hi[k], base + at, v)
            base += len(nodes[0])
        return lo, hi

    def split(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Cut each leaf of the last level whose rows differ; lo and hi are the ranges of all rows."""
        rng, base = np.random.default_rng((self.seed, self.level)), 0
        for t, (feature, split, left, right, path) in enumerate(self.nodes):
            n = size = len(feature)
            for me in np.flatnonzero(path == self.level):
                a, b = lo[:, base + me], hi[:, base + me]
                spread = np.flatnonzero(b > a)
                if len(spread):
                    f = int(rng.choice(spread))
                    cut = rng.uniform(a[f], b[f])
                    if cut > a[f]:
                        feature[me], split[me], left[me], right[me] = f, cut, n, n + 1
                        n += 2
            base += size
            more = (0, n - size)
            self.nodes[t] = (np.pad(feature, more, constant_values=-1), np.pad(split, more), np.pad(left, more), np.pad(right, more), np.pad(path, more, constant_values=self.level + 1.0))
        self.level += 1

    def leaves(self, x: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        x = self.shrunk(x, words)
        every = np.arange(len(x))
        for feature, split, left, right, _ in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                nxt = np.where(x[every, f] < split[at], left[at], right[at])
                at = np.where(inner, nxt, at)
            yield at

    def leaf_counts(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Rows in each node that is a leaf, all trees after one another; adds up over parts of the rows."""
        return np.concatenate([np.bincount(at, minlength=len(n[0])) for at, n in zip(self.leaves(x, words), self.nodes, strict=True)])

    def weigh(self, counts: np.ndarray) -> IsolationForest:
        """Path lengths from the leaf counts of all rows; call once."""
        bounds = np.concatenate([[0], np.cumsum([len(n[0]) for n in self.nodes])])
        for t, (feature, split, left, right, level) in enumerate(self.nodes):
            n = counts[bounds[t] : bounds[t + 1]]
            share = self.size * n / n.sum()
            self.nodes[t] = (feature, split, left, right, level + np.array([average_path(k) for k in share]))
        return self

    def score(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is more anomalous."""
        total = np.zeros(len(x))
        if not self.nodes:
            return total
        for at, nodes in zip(self.leaves(x, words), self.nodes, strict=True):
            total += nodes[4][at]
        return np.exp2(-total / len(self.nodes) / self.norm)


def order_statistics(values: DataFrame, ranks: Callable[[int], list[int]]) -> dict[int, list[float]]:
    """Per ``key`` the values of column ``value`` at the ranks (from 0) that ``ranks`` names for its row count.

    Exact: the range of each rank is narrowed by counts of ``CELLS`` cells until it is one value.
    """
    value = F.col("value")
    found = {r.key: r for r in values.groupBy("key").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}
    at = {(k, i): (r.lo, r.hi, rank) for k, r in found.items() for i, rank in enumerate(ranks(r.n))}
    while spans := sorted({(k, lo, hi) for (k, _), (lo, hi, _) in at.items() if lo < hi}):
        cells = [
            F.when(
                (F.col("key") == k) & value.between(lo, hi),
                F.struct(F.lit(s).alias("span"), F.least(F.floor((value - F.lit(lo)) / F.lit(hi - lo) * CELLS), F.lit(CELLS - 1)).alias("cell")),
            )
            for s, (k, lo, hi) in enumerate(spans)
        ]
        got = values.select("value", F.explode(F.array(*cells)).alias("c")).filter("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        for (k, i), (lo, hi, rank) in at.items():
            if lo < hi:
                for r in sorted((r for r in got if spans[r.c.span] == (k, lo, hi)), key=lambda r: r.c.cell):
                    if rank < r.n:
                        at[k, i] = (r.lo, r.hi, rank)
                        break
                    rank -= r.n
    return {k: [at[k, i][0] for i in range(len(ranks(r.n)))] for k, r in found.items()}


def verdict(forest: IsolationForest, thresholds: np.ndarray, base: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept, score."""
    failed, score = base_failed(base), forest.score(x, base[:, 0])
    return failed, ~failed & (score <= thresholds[np.digitize(base[:, 0], BANDS)]), score


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, z in chunks(texts):
            yield batch.slice(a, z - a), binary_values(texts.slice(a, z - a))


def measured(docs: DataFrame) -> DataFrame:
    """The base counts and features of every row of docs; no shuffle."""

    def measure(batches):
        for batch, texts in _texts(batches):
            base, x = statistics(texts)
            cols = [batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, BASE + ", x array<double>")


def _numbers(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """The named columns side by side, and the features."""
    columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
    x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
    return np.stack(columns, axis=1), x.reshape(batch.num_rows, -1)


def _spans(rows: DataFrame, forest: IsolationForest) -> tuple[np.ndarray, np.ndarray]:
    """``forest.spans`` of all rows; the driver gets one range a leaf and feature."""
    lo = np.full((len(forest.center), sum(len(n[0]) for n in forest.nodes)), math.inf)
    nothing = (lo, -lo)

    def found(batches):
        lo, hi = nothing
        for batch in batches:
            if batch.num_rows:
                words, x = _numbers(batch, "n_words")
                a, b = forest.spans(x, words[:, 0])
                lo, hi = np.minimum(lo, a), np.maximum(hi, b)
        at = np.nonzero(lo <= hi)
        if len(at[0]):
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(lo[at]), pa.array(hi[at])], names=["feature", "node", "lo", "hi"])

    hi = -lo
    for r in rows.mapInArrow(found, "feature long, node long, lo double, hi double").groupBy("feature", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        lo[r.feature, r.node], hi[r.feature, r.node] = r.lo, r.hi
    return lo, hi


def fit(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> tuple[IsolationForest, np.ndarray]:
    """Forest and thresholds from all labelled documents; collects counts and ranges, no rows."""
    return _fit(measured(docs), labels, keep_good)


def _fit(stats: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> tuple[IsolationForest, np.ndarray]:
    thresholds, forest = np.full(len(BANDS) + 1, math.inf), IsolationForest()
    chosen = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    passed = stats.filter("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").select("doc_id", "n_words", "x")
    rows = stage(passed.join(chosen, "doc_id"), "quality-labelled")
    n = rows.count()
    if not n:
        unstage(rows)
        return forest, thresholds
    middle = order_statistics(rows.select(F.posexplode("x").alias("key", "value")), lambda n: [(n - 1) // 2, n // 2])
    forest.open(n, np.array([np.mean(middle[k]) for k in sorted(middle)]))
    while forest.level < forest.depth:
        forest.split(*_spans(rows, forest))

    def count(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                words, x = _numbers(batch, "n_words")
                total = total + forest.leaf_counts(x, words[:, 0])
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["node", "n"])

    counts = np.zeros(sum(len(n[0]) for n in forest.nodes), dtype=np.int64)
    for r in rows.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
        counts[r.node] = r.n
    forest.weigh(counts)

    def scored(batches):
        for batch in batches:
            words, x = _numbers(batch, "n_words")
            yield pa.RecordBatch.from_arrays([pa.array(np.digitize(words[:, 0], BANDS)), pa.array(forest.score(x, words[:, 0]))], names=["key", "value"])

    scores = stage(rows.filter("quality = 1").mapInArrow(scored, "key long, value double"), "quality-scores")
    for band, value in order_statistics(scores, lambda n: [min(n - 1, math.ceil(keep_good * n) - 1)]).items():
        thresholds[band] = value[0] + 1e-12
    unstage(rows, scores)
    return forest, thresholds


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, kept, score.

    Null and empty texts have no words and fail the base rules.  Without labelled rows
    only the base rules reject.  Repeated rows get equal verdicts.  An empty table gives
    an empty result.
    """
    stats = stage(measured(docs), "quality-statistics")
    forest, thresholds = _fit(stats, labels, **options)

    def judge(batches):
        for batch in batches:
            base, x = _numbers(batch, *COUNTS)
            failed, kept, score = verdict(forest, thresholds, base, x)
            cols = [*batch.columns[:6], pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return stats.mapInArrow(judge, BASE + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass, with all their columns; their texts are not shuffled."""
    forest, thresholds = fit(docs, labels, **options)

    def passed(batches):
        for batch, texts in _texts(batches):
            base, x = statistics(texts)
            yield batch.filter(pa.array(verdict(forest, thresholds, base, x)[1]))

    return docs.mapInArrow(passed, docs.schema)


def op4_quality_rules(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
