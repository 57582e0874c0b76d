"""Connected components by alternating large and small stars, on DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import stage, unstage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), "m")
    moved = down.join(least, F.col("u") == F.col("mu")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("mu").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) to one row per linked node other than roots: u, v = smallest node reachable.

    Each round writes its edges to the shared folder; ends when a round changes none.
    """
    edges, before, last = links.select("u", "v").filter("u <> v"), None, None
    for _ in range(MAX_ROUNDS):
        edges = stage(_small_star(_large_star(edges)), "stars")
        if last is not None:
            unstage(last)
        last = edges
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before == now:
            return edges
        before = now
    raise RuntimeError("components did not settle")
