"""Harmonic packing of token sequences.

Items are classed by the reciprocal of the capacity they take: class j holds lengths in
``(capacity / (j + 1), capacity / j]`` and a bin of class j takes j items, whatever they
are.  Documents may be cut, so each is cut where classes are tight: whole sequences
first, then the largest ``capacity // j`` that still fits, until the remainder is at
most ``SMALL`` tokens.  A bin of class j then wastes fewer than j tokens.

Every scan task fills its bins on its own.  Its unfilled bins (fewer than j items in
class j) meet those of ``GROUP`` tasks, fill up there by the same rule, and what then is
left, fewer than j items in class j, is packed best-fit decreasing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import chunks

CAPACITY = 1024
SMALL = 64
GROUP = 64
END_ID = 0
FLUSH_PIECES = 1 << 14
FLUSH_BYTES = 16 << 20
LONG_RUN = 4096
#: white space as the vocabulary's split pattern has it (the Unicode property, as in Rust's ``\\s``)
RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
OPEN = "worker long, class int"
FIELDS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "worker", "class"]


class Encoder:
    """Ids of the byte-level vocabulary, as the ``tokenizers`` library gives them.

    ``tokenizer.json`` is the authority: its vocabulary is turned into ranks for
    tiktoken, whose compiled merge loop gives the same ids several times faster.  The
    split pattern backtracks once for every character of a run of white space and runs
    out of stack on very long ones, so runs of ``LONG_RUN`` or more are cut out by a
    scan and merged as the single piece that the pattern would make of them.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        if model.get("normalizer") or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level vocabularies without normaliser or prefix space are known")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError("added tokens that take neighbouring text are not known")
        self.special = tuple(special)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def parts(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        for run in RUN.finditer(text) if len(text) >= LONG_RUN else ():
            # before a word, the last character of a run goes with the word
            end = run.end() if run.end() == len(text) or text.startswith(self.special, run.end()) else run.end() - 1
            yield self.encoding.encode_to_numpy(text[at : run.start()], allowed_special="all")
            yield np.array(self.encoding._encode_single_piece(text[run.start() : end]), dtype=np.uint32)
            at = end
        yield self.encoding.encode_to_numpy(text[at:], allowed_special="all")

    def __call__(self, text: str) -> np.ndarray:
        return np.concatenate([*self.parts(text), [END_ID]]).astype("<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(tokens: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Piece lengths of a document, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest > small:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


def item_class(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, longest first into the fullest bin that takes it."""
    bins: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(capacity - used, b) for b, used in enumerate(bins) if used + lengths[k] <= capacity]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(0)
        out[k] = (b, bins[b])
        bins[b] += lengths[k]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.int32()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=FIELDS)


def _fill(items: dict[int, list[tuple]], j: int, sequence: int, out: list[tuple]) -> None:
    """One full bin of class j."""
    offset = 0
    for x in items[j]:
        out.append((*x[:4], sequence, offset, x[6], None, None))
        offset += x[2]
    items[j] = []


def _level_one(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, worker, n = encoder(path), TaskContext.get().partitionId(), 0
    waiting: dict[int, list[tuple]] = {}
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for a, z in chunks(batch.column(1)):
            for doc_id, text in zip(batch.column(0).slice(a, z - a).to_pylist(), batch.column(1).slice(a, z - a).to_pylist(), strict=True):
                ids = encode(text or "")
                start = 0
                for length in cut(len(ids), capacity):
                    raw = ids[start : start + length].tobytes()
                    item = (doc_id, start, length, len(ids), None, None, raw, None, None)
                    j = item_class(length, capacity)
                    waiting.setdefault(j, []).append(item)
                    if len(waiting[j]) == j:
                        _fill(waiting, j, worker << 32 | n, out)
                        n += 1
                    start += length
                    held += len(raw)
                    if len(out) >= FLUSH_PIECES or held >= FLUSH_BYTES:
                        yield _batch(out)
                        out, held = [], 0
    out += [(*x[:7], worker, j) for j, items in sorted(waiting.items()) for x in items]
    yield _batch(out)


def _level_two(table: pa.Table, capacity: int) -> pa.Table:
    """Unfilled bins of one group of tasks: at most GROUP * (j - 1) items of each class j."""
    rows = sorted(zip(*(table.column(f).to_pylist() for f in FIELDS), strict=True), key=lambda x: (x[8], x[7], x[0] is not None, x[0] or 0, x[1]))
    group = rows[0][7] // GROUP
    base, n = 1 << 62 | group << 32, 0
    waiting: dict[int, list[tuple]] = {}
    out: list[tuple] = []
    for x in rows:
        j = x[8]
        waiting.setdefault(j, []).append(x)
        if len(waiting[j]) == j:
            _fill(waiting, j, base | n, out)
            n += 1
    rest = [x for j in sorted(waiting) for x in waiting[j]]
    for x, (b, offset) in zip(rest, best_fit([x[2] for x in rest], capacity), strict=True):
        out.append((*x[:4], base | (n + b), offset, x[6], None, None))
    return pa.Table.from_batches([_batch(out)])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its tokens, then id 0; null and empty texts are that id alone.
    ``ids`` are little-endian unsigned 32-bit values and go with their piece through
    both levels; ``ids_crc32`` is taken from them as packed.  Rows that repeat an id are
    separate documents, and the order of ties among them is free.  A very long text is
    encoded by one task, in time proportional to its length (times its logarithm for one
    unbroken run), and its pieces leave that task in batches; long runs of one kind of
    character give the ids that ``tokenizers`` gives.  An empty table gives an empty result.
    """
    schema = f"{PIECES}, {OPEN}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    from stratum.llm.common import stage

    first = stage(rows.mapInArrow(lambda b: _level_one(b, tokenizer, capacity), schema), "pack")
    done = first.filter("worker is null").select(FIELDS[:7])
    left = first.filter("worker is not null").groupBy(F.floor(F.col("worker") / GROUP)).applyInArrow(lambda t: _level_two(t, capacity), schema)
    return done.unionByName(left.select(FIELDS[:7])).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


def op3_packing(spark, sf_dir):
    """The pieces with a digest of their packed ids in place of the ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
