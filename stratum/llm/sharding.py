"""Histogram sort: splitters from exact byte counts, then one exchange of whole rows.

The order is (64-bit text hash, doc_id), so equal texts are neighbours.  Every round
counts, in each partition, the exact bytes, rows and extreme keys between candidate
boundaries; the sums (at most ``shards * (PROBES + 1)`` rows, whatever the corpus) tell
which interval holds each target, and new probes divide that interval only.  A splitter
is done when its bytes are within ``tolerance`` of its target or its interval holds one
key.  Group edges are probes too: a boundary that lands inside a group of equal texts
moves to the nearer edge where tolerance allows; a larger group is cut by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import stage, staged_path

SHARDS = 40
OVERHEAD = 16
TOLERANCE = 0.002
PROBES = 16
MAX_ROUNDS = 40
SUB_ROWS = 1 << 20
SUB_BYTES = 1 << 28
SIGN = 1 << 63
TOP = (1 << 128) - 1

COUNTS = "slot int, bytes long, rows long, low_h decimal(20,0), low_d decimal(20,0), high_h decimal(20,0), high_d decimal(20,0)"


def _key(h: int, d: int) -> int:
    return ((h + SIGN) << 64) | (d + SIGN)


def _slots(h: np.ndarray, d: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """Number of probes at or below each key (h, d); probes are sorted."""
    ph = np.array([p[0] for p in probes], dtype=np.int64)
    low, high = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    shared = np.flatnonzero(low != high)
    for a in np.unique(low[shared]).tolist():  # probes of one hash: by id
        rows = shared[low[shared] == a]
        own = np.array([p[1] for p in probes[a : high[rows[0]]]], dtype=np.int64)
        low[rows] = a + np.searchsorted(own, d[rows], "right")
    return low


def _histogram(batches: Iterator[pa.RecordBatch], probes: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    n = len(probes) + 1
    size, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    low: list = [None] * n
    high: list = [None] * n
    for batch in batches:
        h, d, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        slot = _slots(h, d, probes)
        order = np.lexsort((d, h, slot))
        slot, h, d, b = slot[order], h[order], d[order], b[order]
        edge = np.flatnonzero(np.diff(slot, prepend=-1))
        ends = np.append(edge[1:], len(slot)) - 1
        for first, last, total in zip(edge.tolist(), ends.tolist(), np.add.reduceat(b, edge).tolist() if len(edge) else [], strict=True):
            k = int(slot[first])
            size[k] += total
            rows[k] += last - first + 1
            a, z = (int(h[first]), int(d[first])), (int(h[last]), int(d[last]))
            low[k] = a if low[k] is None or a < low[k] else low[k]
            high[k] = z if high[k] is None or z > high[k] else high[k]
    used = np.flatnonzero(rows).tolist()
    dec = pa.decimal128(20, 0)
    from decimal import Decimal

    cols = [pa.array(used, pa.int32()), pa.array(size[used]), pa.array(rows[used])]
    cols += [pa.array([Decimal(x[k][j]) for k in used], dec) for x in (low, high) for j in (0, 1)]
    yield pa.RecordBatch.from_arrays(cols, names=["slot", "bytes", "rows", "low_h", "low_d", "high_h", "high_d"])


def _count(keys: DataFrame, probes: list[tuple[int, int]]) -> list:
    """Exact totals per interval, at most len(probes) + 1 rows."""
    probes = sorted(set(probes))
    parts = keys.select("h", "d", "size").mapInArrow(lambda b: _histogram(b, probes), COUNTS)
    got = parts.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min(F.struct("low_h", "low_d")).alias("low"), F.max(F.struct("high_h", "high_d")).alias("high")).collect()
    return sorted((r.slot, int(r.bytes), int(r.rows), tuple(map(int, r.low)), tuple(map(int, r.high))) for r in got)


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[list[tuple[int, int]], list]:
    """Boundaries (a shard holds keys at or above its own, below the next) and the last counts."""
    counts = _count(keys, [])
    if not counts:
        return [], []
    _, total, _, lowest, highest = counts[0]
    slack = tolerance * total / shards
    #: for each target: bytes below lo (all keys < lo), bytes up to and with hi
    state = {s: {"goal": total * s / shards, "lo": lowest, "below": 0, "hi": highest, "upto": total, "best": (abs(total * s / shards), lowest)} for s in range(1, shards)}
    for _ in range(MAX_ROUNDS):
        wanted = []
        for x in state.values():
            if x["best"][0] <= slack or x["lo"] >= x["hi"]:
                continue
            a, z = _key(*x["lo"]), _key(*x["hi"])
            if x["lo"][0] != x["hi"][0]:  # whole groups first: boundaries at (h, smallest id)
                a, z = x["lo"][0] + SIGN, x["hi"][0] + SIGN
                step = max(1, (z - a) // (probes + 1))
                points = {min(z, a + step * k) for k in range(1, probes + 1)} | {z}
                wanted += [(p - SIGN, -SIGN) for p in points]
            else:
                step = max(1, (z - a) // (probes + 1))
                points = {min(z, a + step * k) for k in range(1, probes + 1)} | {z}
                wanted += [((p >> 64) - SIGN, (p & ((1 << 64) - 1)) - SIGN) for p in points]
        if not wanted:
            break
        wanted = sorted(set(wanted))
        counts = _count(keys, wanted)
        below = 0
        for _slot, size, _rows, low, high in counts:
            for x in state.values():
                # the boundary just before this interval's first key
                if (off := abs(below - x["goal"])) < x["best"][0]:
                    x["best"] = (off, low)
                if below <= x["goal"] < below + size:
                    x["lo"], x["below"], x["hi"], x["upto"] = low, below, high, below + size
            below += size
    return [state[s]["best"][1] for s in range(1, shards)], counts


def _key_columns(docs: DataFrame) -> tuple[Column, Column, Column]:
    """Text hash, id (null: the smallest) and size of a row; every row finds its place from these alone."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.xxhash64(text), F.coalesce(docs["doc_id"].cast("long"), F.lit(-SIGN)), F.octet_length(text).cast("long")


def placed(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, overhead: int = OVERHEAD, sub_rows: int = SUB_ROWS, sub_bytes: int = SUB_BYTES) -> DataFrame:
    """Whole rows of docs after the exchange, with shard and slot.

    The histogram runs on staged keys; the exchange moves the rows themselves.  Within a
    shard, slots are numbered in sub-ranges of at most ``sub_rows`` rows and ``sub_bytes``
    bytes, so no task sorts a whole shard, nor a whole group of equal texts.
    """
    h, d, size = _key_columns(docs)
    keys = stage(docs.select(h.alias("h"), d.alias("d"), (size + overhead).alias("size")), "shard-keys")
    bounds, _ = splitters(keys, shards, tolerance)
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # sub-ranges for numbering: even ranges of the hash, found by a shift, cut again at shards
    # and wherever a range holds too much (a large group of equal texts is cut by id)
    power = max(0, (4 * max(1, -(-n // sub_rows), -(-total // sub_bytes)) - 1).bit_length())
    even = [(-SIGN + (k << (64 - power)), -SIGN) for k in range(1, 1 << power)]
    fine: set[tuple[int, int]] = {*bounds} - {*even}
    counted = _count(keys, [*even, *fine]) if n else []
    for _ in range(MAX_ROUNDS):
        full = [x for x in counted if (x[2] > sub_rows or x[1] > sub_bytes) and x[3] != x[4]]
        if not full:
            break
        for _slot, size_, rows_, low, high in full:
            a, z = _key(*low), _key(*high)
            step = max(1, (z - a) // (2 * max(-(-rows_ // sub_rows), -(-size_ // sub_bytes))))
            fine |= {((p >> 64) - SIGN, (p & ((1 << 64) - 1)) - SIGN) for p in [*range(a + step, z, step), z]}
        fine -= {*even}
        counted = _count(keys, [*even, *fine])
    cuts = sorted([*even, *fine])
    starts, of_shard = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    current = in_shard = 0
    for slot, _size, rows, _low, _high in counted:
        owner = sum(1 for b in bounds if b <= (cuts[slot - 1] if slot else (-SIGN - 1, 0)))
        if owner != current:
            current, in_shard = owner, 0
        starts[slot], of_shard[slot] = in_shard, owner
        in_shard += rows

    def longs(values):
        return F.lit(values).cast("array<long>")

    sub = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-SIGN)), 64 - power).cast("int") if power else F.lit(0)
    if fine:
        listed = sorted(fine)
        edges = F.arrays_zip(longs([c[0] for c in listed]).alias("h"), longs([c[1] for c in listed]).alias("d"))
        sub = sub + F.size(F.filter(edges, lambda c: (c["h"] < F.col("h")) | ((c["h"] == F.col("h")) & (c["d"] <= F.col("d")))))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), h.alias("h"), d.alias("d")).withColumn("sub", sub)
    rows = rows.withColumn("shard", F.element_at(longs(of_shard), F.col("sub") + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("sub").orderBy("h", "d"))
    return rows.select("row.*", "shard", (F.element_at(longs(starts), F.col("sub") + 1) + rank - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> DataFrame:
    """Exchange docs once, write one folder per shard (shard=0, ...), rows in slot order, and read it back."""
    out = placed(docs, shards, **options)
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, overhead: int = OVERHEAD, sub_rows: int = SUB_ROWS) -> DataFrame:
    """One row per row of docs, read from the written shards: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes (null: none) plus ``overhead``.  Slots are gapless
    from 0 in the order (text hash, doc_id); a null doc_id sorts first in its group.
    Rows that repeat an id are rows of their own and stay neighbours; rows equal in id and
    text are interchangeable, and all such rows of one id and text are numbered by one
    task.  A very long text is one row, whole in one shard.  Extra columns travel along.
    An empty table gives an empty result; fewer rows than shards leave shards empty.
    """
    rows = write_shards(docs, staged_path(docs.sparkSession, "shards"), shards, tolerance=tolerance, overhead=overhead, sub_rows=sub_rows)
    _, _, size = _key_columns(rows)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (size + overhead).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
