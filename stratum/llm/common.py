"""Helpers shared by the corpus operators: staging, words and vectorised word hashes.

White space is ASCII throughout: ``[\\x20\\x09-\\x0D]``; a word is a maximal run of
anything else.  ``bytes.split()`` splits on exactly that set.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
CHUNK_BYTES = 2 << 20
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LONG_WORD = 64

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: every ASCII byte but letters and digits
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own (one machine only)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stratum-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed at exit."""
    path = f"{shared_dir(spark)}/stratum/{tag}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Shuffle files of the write are removed with it, instead of whenever the driver next
    collects its garbage.
    """
    spark = df.sparkSession
    path, before = staged_path(spark, tag), spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratum_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df._stratum_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table; a stopped session has nothing left to remove it with."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def word_count(text: Column) -> Column:
    """Number of words, JVM side; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def binary_values(array: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]


def chunks(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(array).to_pylist()], dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of several texts in one buffer: ``start``/``end`` byte offsets and ``first`` word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, separators: np.ndarray = _IS_SPACE):
        self.buffer = b"".join(texts)
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        if lower:
            data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))
        self.data = data
        solid = ~separators[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        begins[inner] = solid[inner]
        self.start = np.flatnonzero(begins)
        stops = solid.copy()
        stops[:-1] &= ~solid[1:]
        last = bounds[1:][bounds[1:] > 0] - 1
        stops[last] = solid[last]
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.first[-1] = len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word (FNV-1a with a finaliser; long words by blake2b)."""
        length = self.end - self.start
        prime = np.uint64(0x100000001B3)
        h = np.full(len(length), np.uint64((0xCBF29CE484222325 + seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        if seed:
            prime = np.uint64(0x9E3779B97F4A7C15)
        active = np.flatnonzero(length <= LONG_WORD)
        k = 0
        while len(active):
            h[active] = (h[active] ^ self.data[self.start[active] + k]) * prime
            k += 1
            active = active[length[active] > k]
        for i in np.flatnonzero(length > LONG_WORD):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            h[i] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([seed])).digest(), "little"))
        return mix(h)


def gram_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every n consecutive values of h (may run over text bounds; callers mask those)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(salt + n))
    step = np.uint64(0x9FB21C651E98DF25)
    for k in range(n):
        out = (out + h[k : len(h) - n + 1 + k]) * step
        out ^= out >> np.uint64(29)
    return mix(out)
