"""Tables that are written once and then read by many queries, as a database keeps its own.

They live in the folder that driver and executors share.  A table is written again when
the application, the input folder or the list of its files changes.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else (on one machine only) a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="stratum-")
    spark.sparkContext.setCheckpointDir(base)
    return base


SHARE_BYTES = 16 << 20


def shares(table: DataFrame) -> int:
    """Number of partitions for work on a whole table: one per 16 MB of its files, so that a task's memory does not grow with them."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE_BYTES))


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def write(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its size is known to the planner, its lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratum-tables/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, sf_dir: str, name: str, tables: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from ``tables`` of sf_dir, written on first use."""
    files = sorted(f for t in tables for f in spark.read.parquet(f"{sf_dir}/{t}.parquet").inputFiles())
    key = (spark.sparkContext.applicationId, name, hashlib.sha256("\n".join([sf_dir, *files]).encode()).hexdigest())
    if key not in _known:
        df = make()
        path = f"{shared_dir(spark)}/stratum-tables/{name}-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, path)
        df.write.parquet(path)
        _known[key] = path
    return spark.read.parquet(_known[key])
