"""Repeated passages: a count-min prefilter, then exact grouping of what it lets through.

A window is ``WINDOW`` consecutive words.  The sketch does not count windows one by one:
each window is counted under the smallest hash of its ``GRAM``-word runs, its *cell*, a
value that depends on the window's words alone, so the count of its cell is never below
the number of documents that hold the window.  Few cells represent many windows (about
one per four), which keeps the sketch small.

*Sketch.*  ``ROWS`` rows of ``2 ** sketch_bits`` counters.  Every scan task keeps sketches
of its own documents, each document counting once per cell, and sends them in slices
(positions delta-coded, one byte each as a rule); slices are added up, counters staying
at 2, which is all that is asked.  What comes back is one bit per counter, at most
``ROWS * 2 ** sketch_bits / 8`` bytes (64 MB as built), whatever the corpus.  With n cells
in the corpus, a cell of one document is let through with probability at most
``(n / 2 ** sketch_bits) ** ROWS``: 7 % for 70 million cells.  A fuller sketch
lets more through, up to everything; it never holds back a repeated window.

*Second pass.*  Documents send (cell, doc_id) for the cells that the sketch lets through;
these are grouped exactly, documents that hold a repeated one hash the windows of those
cells (128 bits), and these alone are grouped, exactly, for the smallest doc_id of each.
Documents whose whole word sequence is that of an earlier document need no windows: each
of theirs also starts in that earlier document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import Words, binary_values, chunks, gram_hashes, mix, stage, unstage

WINDOW = 13
GRAM = 8
ROWS = 2
SKETCH_BITS = 28
SLICE_BITS = 20
FLUSH_CELLS = 1 << 21
CHUNK = 1 << 20
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    out = values[:n].copy()
    for k in range(1, width):
        np.minimum(out, values[k : k + n], out=out)
    return out


class Windows:
    """Windows of several texts: cell of each, and the position and text of its first word."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.words = Words(texts)
        self.n = np.diff(self.words.first)
        h = self.words.hashes()
        self.h, self.window = h, window
        doc_of = np.repeat(np.arange(len(texts)), self.n)
        grams = gram_hashes(h, gram)
        if len(h) < window:
            self.at, self.owner, self.cell = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        least = _sliding_min(grams, window - gram + 1)
        self.at = np.flatnonzero(doc_of[window - 1 :] == doc_of[: len(least)])
        self.owner = doc_of[self.at]
        self.cell = least[self.at].view(np.int64)

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the chosen windows (indices into at)."""
        if not len(which):
            return (np.empty(0, dtype=np.int64),) * 2
        one = gram_hashes(self.h, self.window, 5)[self.at[which]]
        two = gram_hashes(self.words.hashes(1), self.window, 11)[self.at[which]]
        return one.view(np.int64), two.view(np.int64)


def _distinct(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions of one row for each distinct (owner, keys)."""
    if not len(owner):
        return np.empty(0, dtype=np.int64)
    order = np.lexsort((*keys[::-1], owner))
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for a in (owner, *keys):
        new[1:] |= a[order][1:] != a[order][:-1]
    return order[new]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, z in chunks(texts, CHUNK):
            yield batch.slice(a, z - a), binary_values(texts.slice(a, z - a))


def counters(cells: np.ndarray, row: int, sketch_bits: int) -> np.ndarray:
    """Counter of each cell in a row of the sketch."""
    return mix(cells.view(np.uint64) * SEEDS[row] + np.uint64(row)) >> np.uint64(64 - sketch_bits)


def encode(positions: np.ndarray) -> bytes:
    """Sorted positions as differences; 255 adds 255 and goes on."""
    d = np.diff(positions, prepend=np.uint64(0))
    more = (d // np.uint64(255)).astype(np.int64)
    out = np.full(len(d) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = (d % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def decode(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def partition_sketch(cells: np.ndarray, sketch_bits: int, slice_bits: int) -> Iterator[tuple[int, bytes]]:
    """Non-empty slices of the sketch of these cells (one for each document that holds it)."""
    if not len(cells):
        return
    per_row = 1 << (sketch_bits - slice_bits)
    for row in range(ROWS):
        at = np.sort(counters(cells, row, sketch_bits))
        again = np.zeros(len(at), dtype=bool)  # the third and later of equal positions: two are enough
        again[2:] = at[2:] == at[:-2]
        at = at[~again]
        number = at >> np.uint64(slice_bits)
        cuts = np.flatnonzero(np.diff(number, prepend=np.uint64(1 << 63)))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            yield row * per_row + int(number[a]), encode(at[a:z] & np.uint64((1 << slice_bits) - 1))


def _scan(batches, window: int, gram: int, sketch_bits: int, slice_bits: int) -> Iterator[pa.RecordBatch]:
    """Slices of this task's sketches; and, for each document with words, a digest of its word sequence."""
    names = ["slice", "blob", "doc_id", "sequence"]
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        found = list(partition_sketch(np.concatenate(held), sketch_bits, slice_bits)) if held else []
        held.clear()
        none = [None] * len(found)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names=names)

    for batch, texts in _rows(batches):
        w = Windows(texts, window, gram)
        held.append(w.cell[_distinct(w.owner, w.cell)])
        if sum(map(len, held)) >= FLUSH_CELLS:
            yield flush()
        own = [hashlib.sha256(b" ".join(words)).digest() if len(words := t.split()) >= window else None for t in texts]
        none = [None] * len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.int32()), pa.array(none, pa.binary()), batch.column(0), pa.array(own, pa.binary())], names=names)
    yield flush()


def _merge(batches: Iterator[pa.RecordBatch], slice_bits: int) -> Iterator[pa.RecordBatch]:
    """Slices of partition sketches to one bit per counter: whether their sum is 2 or more."""
    width, most = 1 << slice_bits, 1 << 20
    sums: dict[int, np.ndarray] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def add(k: int) -> None:
        more = np.minimum(np.bincount(np.concatenate(waiting.pop(k)), minlength=width), 2).astype(np.uint8)
        sums[k] = np.minimum(sums[k] + more, 2) if k in sums else more

    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(k, []).append(decode(blob))
            if sum(map(len, waiting[k])) >= most:
                add(k)
    def bits(k: int) -> np.ndarray:
        if k in sums:
            if k in waiting:
                add(k)
            return np.packbits(sums.pop(k) >= 2)
        at = np.sort(np.concatenate(waiting.pop(k)))  # few positions: no counters are laid out
        at = at[1:][at[1:] == at[:-1]]
        out = np.zeros(width // 8, dtype=np.uint8)
        np.bitwise_or.at(out, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        return out

    for k in sorted({*sums, *waiting}):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits(k).tobytes()], pa.binary())], names=["slice", "bits"])


class Repeated:
    """The merged sketch as bits; tells which cells may be in two documents."""

    def __init__(self, slices: list[tuple[int, bytes]], sketch_bits: int, slice_bits: int):
        self.bits, self.sketch_bits = np.zeros(max(1, ROWS << sketch_bits >> 3), dtype=np.uint8), sketch_bits
        for k, raw in slices:
            self.bits[k << slice_bits >> 3 :][: len(raw)] = np.frombuffer(raw, dtype=np.uint8)

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        out = np.ones(len(cells), dtype=bool)
        for row in range(ROWS):
            at = counters(cells, row, self.sketch_bits) + np.uint64(row << self.sketch_bits)
            out &= (self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        return out


def _let_through(batches, window: int, gram: int, repeated) -> Iterator[pa.RecordBatch]:
    """(cell, doc_id) of the cells estimated repeated, once per document."""
    for batch, texts in _rows(batches):
        w = Windows(texts, window, gram)
        one = _distinct(w.owner, w.cell)
        one = one[repeated.value(w.cell[one])]
        ids = batch.column(0).take(pa.array(w.owner[one]))
        yield pa.RecordBatch.from_arrays([pa.array(w.cell[one]), ids], names=["cell", "doc_id"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _candidates(batches, window: int) -> Iterator[pa.RecordBatch]:
    """Finished rows of documents without repeated cells or that copy an earlier one; the others keep text and cells."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text", "cells"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
    for batch, texts in _rows(batches):
        ids, cells, copies, asked = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "cells", "copy", "with_text"))
        out = []
        for doc_id, text, own, copy, wanted in zip(ids, texts, cells, copies, asked, strict=True):
            words = text.split()
            if copy and len(words) >= window:
                out.append((doc_id, len(words), len(words), _digest([]), "" if wanted else None, None, None))
            elif own and not copy:
                out.append((doc_id, len(words), None, None, None, text.decode(), own))
            else:
                out.append((doc_id, len(words), 0, _digest(words), b" ".join(words).decode() if wanted else None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _windows(batches, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(hash, hash, doc_id) of the windows whose cell is repeated, once per document."""
    for batch, texts in _rows(batches):
        w = Windows(texts, window, gram)
        cells = batch.column(batch.schema.get_field_index("cells"))
        listed = np.zeros(len(w.at), dtype=bool)
        bounds = np.searchsorted(w.owner, np.arange(len(texts) + 1))
        for i, own in enumerate(cells):
            listed[bounds[i] : bounds[i + 1]] = np.isin(w.cell[bounds[i] : bounds[i + 1]], own.values.to_numpy(zero_copy_only=False))
        which = np.flatnonzero(listed)
        a, b = w.hashes(which)
        one = _distinct(w.owner[which], a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one]), batch.column(0).take(pa.array(w.owner[which][one]))], names=["wa", "wb", "doc_id"])


def _remove(batches, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Words left when those of the listed windows are gone."""
    for batch, texts in _rows(batches):
        w = Windows(texts, window, gram)
        a, b = w.hashes(np.arange(len(w.at)))
        drops = batch.column(batch.schema.get_field_index("drop"))
        bounds = np.searchsorted(w.owner, np.arange(len(texts) + 1))
        rows = []
        for i, text in enumerate(texts):
            words, listed = text.split(), drops[i].as_py()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if listed:
                s = slice(bounds[i], bounds[i + 1])
                pairs = set(zip((x["wa"] for x in listed), (x["wb"] for x in listed), strict=True))
                hit = np.fromiter((p in pairs for p in zip(a[s].tolist(), b[s].tolist(), strict=True)), dtype=bool, count=bounds[i + 1] - bounds[i])
                start = w.at[s][hit] - w.words.first[i]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
            left = [x for x, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
            rows.append((len(words), len(words) - len(left), _digest(left), b" ".join(left).decode()))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def merged_sketch(scanned: DataFrame, sketch_bits: int, slice_bits: int) -> Repeated:
    """The sum of all partition sketches; what reaches the driver is bounded by the sketch's size."""
    slices = scanned.filter("slice is not null").select("slice", "blob").repartition("slice")
    got = slices.mapInArrow(lambda b: _merge(b, slice_bits), "slice int, bits binary").collect()
    return Repeated([(r["slice"], bytes(r["bits"])) for r in got], sketch_bits, slice_bits)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, sketch_bits: int = SKETCH_BITS, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Each word covered by a window that also starts in a document with a smaller id is
    removed.  Null and empty texts have no words.  Rows without doc_id neither remove
    nor lose words; rows that repeat a doc_id count as one document, do not remove each
    other's words and are each returned once.  A very long text is one task's work, in
    memory proportional to its length.  An empty table gives an empty result; columns
    other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, args, slice_bits = rows.filter("doc_id is not null"), (window, gram), min(SLICE_BITS, sketch_bits)
    scanned = stage(known.mapInArrow(lambda b: _scan(b, *args, sketch_bits, slice_bits), "slice int, blob binary, doc_id long, sequence binary"), "sketches")
    repeated = docs.sparkSession.sparkContext.broadcast(merged_sketch(scanned, sketch_bits, slice_bits))

    named = scanned.filter("slice is null").select("doc_id", "sequence")
    first = stage(named.filter("sequence is not null").groupBy("sequence").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sequence", "first"), "sequences")
    # a document is a copy if each of its rows (repeated ids) is, or has no window
    copies = named.join(first, "sequence", "left").groupBy("doc_id").agg(F.bool_and(F.col("sequence").isNull() | (F.coalesce("first", "doc_id") < F.col("doc_id"))).alias("copy"), F.count("first").alias("n"))
    copies = stage(copies.filter("copy and n > 0").select("doc_id", "copy"), "copies")

    # what is repeated among the copies is repeated in their first documents or not at all
    passed = stage(known.mapInArrow(lambda b: _let_through(b, *args, repeated), "cell long, doc_id long"), "cells")
    counted = passed.join(copies, "doc_id", "left_anti")
    twice = stage(counted.groupBy("cell").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("cell"), "repeated")
    cells = counted.join(twice, "cell").groupBy("doc_id").agg(F.collect_set("cell").alias("cells"))

    marked = rows.join(cells, "doc_id", "left").join(copies, "doc_id", "left").withColumn("with_text", F.lit(with_text))
    staged = stage(marked.mapInArrow(lambda b: _candidates(b, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, text string, cells array<long>"), "passages")
    todo = staged.filter("cells is not null").select("doc_id", "text", "cells")
    found = stage(todo.mapInArrow(lambda b: _windows(b, *args), "wa long, wb long, doc_id long"), "windows")
    least = stage(found.groupBy("wa", "wb").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("wa", "wb", "first"), "least")
    drop = found.join(least, ["wa", "wb"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("wa", "wb")).alias("drop"))
    cut = todo.select("doc_id", "text").join(drop, "doc_id", "left").mapInArrow(lambda b: _remove(b, *args), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    unstage(scanned, first, passed, twice)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return staged.filter("cells is null").select(*names).unionByName(cut.select(*names))


def op8_substring_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS first FROM s
), r AS (
  SELECT DISTINCT doc_id, i + k AS p FROM g, (SELECT unnest(range(0, 13)) AS k) WHERE first < doc_id
), t AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w
), k AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS body, count(*) AS n FROM t ANTI JOIN r ON t.doc_id = r.doc_id AND t.p = r.p GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
