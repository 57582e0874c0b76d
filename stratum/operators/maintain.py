"""Keyed maintenance: merges, deletes, freshness transitions, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], last_wins: bool) -> DataFrame:
    """Upsert (last wins) or insert-or-ignore (first wins); one row per key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    order = F.desc("_turn") if last_wins else F.asc("_turn")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *[c for c in old.columns if c not in keys]))
    return both.withColumn("_k", first).filter("_k = 1").drop("_k", "_turn")


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def added(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    return head.join(base.select(*keys).distinct(), keys, "left_anti")


TRANSITIONS = {"file": ("stale", None), "evidence": ("stale", ("fresh",)), "commit": ("stale", ("fresh",)), "target": ("stale", ("fresh", "dirty-dependent")), "fence": ("dirty-dependent", ("fresh",)), "restore": ("fresh", ("dirty-dependent",))}


def transition(state: Column, event: str, touched: Column) -> Column:
    """Freshness after an event; states outside the event's guard stay."""
    to, guard = TRANSITIONS[event]
    allowed = touched if guard is None else touched & state.isin(*guard)
    return F.when(allowed, F.lit(to)).otherwise(state)


def stale_queue(items: DataFrame, done: DataFrame, key: str, model: str) -> DataFrame:
    """Items without an embedding of this model, or with another content hash."""
    own = done.filter(F.col("model") == model).select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"))
    return items.join(own, F.col(key) == F.col("_k"), "left").filter(F.col("_k").isNull() | (F.col("_h") != F.col("content_hash"))).drop("_k", "_h")


def qualified_ids(declared: DataFrame) -> DataFrame:
    """id, file -> id made unique: an id that several files declare carries its file."""
    many = declared.groupBy("id").agg(F.countDistinct("file").alias("files"))
    return declared.join(many, "id").withColumn("qualified", F.when(F.col("files") > 1, F.concat("id", F.lit("#file:"), "file")).otherwise(F.col("id")))
