"""Grace hash deduplication of whole texts.

Texts are equal when identical after each run of white space became one space.  The
plan has three parts:

1. *Map-side combine*: every scan task folds its own equal texts into one record
   (digest, text, smallest id, count), so a text that holds a third of all rows enters
   the exchange once per task.
2. *Grace partitioning*: records are exchanged by digest; a task whose share does not
   fit ``memory_bytes`` deals it to spill files by further digest bits, and deals each
   file again until it fits an open-addressing table.  The table compares complete
   contents, never digests alone; two texts under one digest raise an error.  Spill
   files are private scratch of the task (as Spark's own sort spills are), removed
   before it ends, and made anew from the exchange when a task is retried.
3. *Membership*: rows (id and digest only) join the classes on the digest; a hot digest
   is split by adaptive execution, as its class is one row.
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import SPACE, stage

MEMORY_BYTES = 64 << 20
COMBINE_BYTES = 16 << 20
FANOUT = 16
RECORD = struct.Struct("<qqI")

CLASS_SCHEMA = "digest binary, keep_id long, group_size long"
LOCAL_SCHEMA = "digest binary, content binary, min_id long, n long"


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class OpenTable:
    """Open addressing with linear probing; slots hold entry numbers, contents decide equality."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.min_ids: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, min_id: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self.slots[at]) >= 0:
            if self.digests[k] == digest:
                if self.contents[k] != content:
                    raise ValueError("two different texts have one SHA-256 digest")
                old = self.min_ids[k]
                if old is None or (min_id is not None and min_id < old):
                    self.min_ids[k] = min_id if min_id is not None else old
                self.counts[k] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.digests)
        self.digests.append(digest)
        self.contents.append(content)
        self.min_ids.append(min_id)
        self.counts.append(n)
        self.bytes += len(content) + 200
        if 2 * len(self.digests) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for k, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, int | None, int]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _combine(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Equal texts of a task as one record; the table is emptied beyond ``limit`` bytes."""
    table = OpenTable()

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(table.digests, pa.binary()), pa.array(table.contents, pa.binary()), pa.array(table.min_ids, pa.int64()), pa.array(table.counts, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["digest", "content", "min_id", "n"])

    for record in _records(batches):
        table.add(*record)
        if table.bytes > limit:
            yield flush()
            table = OpenTable()
    if table.digests:
        yield flush()


def _write(file, digest: bytes, content: bytes, min_id: int | None, n: int) -> None:
    known = min_id is not None
    file.write(RECORD.pack(min_id if known else 0, n if known else -n, len(content)))
    file.write(digest)
    file.write(content)


def _read(path: str) -> Iterator[tuple[bytes, bytes, int | None, int]]:
    with open(path, "rb", buffering=1 << 20) as file:
        while head := file.read(RECORD.size):
            min_id, n, size = RECORD.unpack(head)
            digest = file.read(32)
            yield digest, file.read(size), (min_id if n > 0 else None), abs(n)


def grace(records: Iterator[tuple[bytes, bytes, int | None, int]], limit: int, fanout: int = FANOUT, level: int = 0, scratch: str | None = None) -> Iterator[OpenTable]:
    """Tables that together hold every distinct content once.

    Copies never make a table larger, so only distinct contents beyond ``limit`` cause
    another level.  Level k deals by digest byte k + 8; one record alone always fits.
    """
    table = OpenTable()
    rest = iter(records)
    for record in rest:
        table.add(*record)
        if table.bytes > limit and len(table.digests) > 1 and level < 20:
            break
    else:
        if table.digests:
            yield table
        return
    own = tempfile.mkdtemp(prefix="grace-", dir=scratch)
    try:
        paths = [os.path.join(own, str(k)) for k in range(fanout)]
        files = [open(p, "wb", buffering=1 << 18) for p in paths]
        try:
            for entry in zip(table.digests, table.contents, table.min_ids, table.counts, strict=True):
                _write(files[entry[0][level + 8] % fanout], *entry)
            table = OpenTable()
            for record in rest:
                _write(files[record[0][level + 8] % fanout], *record)
        finally:
            for file in files:
                file.close()
        for path in paths:
            yield from grace(_read(path), limit, fanout, level + 1, own)
            os.remove(path)
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _classes(batches: Iterator[pa.RecordBatch], limit: int, fanout: int) -> Iterator[pa.RecordBatch]:
    for table in grace(_records(batches), limit, fanout):
        yield pa.RecordBatch.from_arrays([pa.array(table.digests, pa.binary()), pa.array(table.min_ids, pa.int64()), pa.array(table.counts, pa.int64())], names=["digest", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, memory_bytes: int = MEMORY_BYTES, combine_bytes: int = COMBINE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other.  A null doc_id is
    never the smallest unless its whole group has none (keep_id null; kept is then true
    for each such row, as ids cannot tell them apart).  Repeated rows (same id and
    text) count in group_size and share one verdict.  A very long text is one record; a
    task holds at most ``combine_bytes`` or ``memory_bytes`` besides it.  An empty table
    gives an empty result; columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"))
    digest = F.unhex(F.sha2("content", 256))
    full = rows.select(digest.alias("digest"), F.col("content").cast("binary").alias("content"), F.col("doc_id").alias("min_id"), F.lit(1).cast("long").alias("n"))
    combined = full.mapInArrow(lambda b: _combine(b, combine_bytes), LOCAL_SCHEMA)
    classes = combined.repartition("digest").mapInArrow(lambda b: _classes(b, memory_bytes, fanout), CLASS_SCHEMA)
    members = rows.select("doc_id", digest.alias("digest"))
    return members.join(classes, "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row for each distinct text, that of the smallest id, with all columns of docs.

    Rows that repeat both id and text, and rows without id, leave one row of their text
    (any of them).
    """
    kept = exact_dedup(docs).filter("kept").groupBy(F.col("keep_id").alias("__keep_id"), F.unhex("text_sha256").alias("__keep_digest")).agg(F.count(F.lit(1)).alias("__times"))
    kept = stage(kept, "kept-first")
    rows = docs.withColumn("__digest", F.unhex(F.sha2(normalised(docs["text"]), 256)))
    same = (F.col("__digest") == F.col("__keep_digest")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__keep_id"))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    if kept.filter("__times > 1").isEmpty():
        return rows.join(kept, same, "left_semi").select(columns)
    once = rows.join(kept.filter("__times = 1"), same, "left_semi").select(columns)
    return once.unionByName(rows.join(kept.filter("__times > 1"), same, "left_semi").dropDuplicates(["__digest"]).select(docs.columns))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
