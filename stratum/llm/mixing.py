"""Mixing sources to target weights: Efraimidis-Spirakis sampling, DataFrame operations only.

Targets.  Sources in code-point order (null last) take the weights in turn.  The budget
is shared by weight; no target exceeds ``max_epochs`` times its source, and the excess
goes to the other sources by weight.  That fixed point is a water level: targets are
``min(cap, level * weight)``, found by one running sum over the sources sorted by
``cap / weight``.

Choice.  A source's whole epochs come first.  The fraction that remains is drawn without
replacement: each document gets ``-ln(u) / quality`` with u a hash of its id and text, and the
smallest keys are taken until the budget is reached.  To order a source that may hold a
third of all rows, keys are first counted in ``BINS`` intervals; only documents of the
one interval in which the budget ends are sorted.  Documents are taken whole, so the
prefix stops short of the budget; one more document, the one whose size is nearest to
what is missing, may follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import stage, unstage, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
BINS = 4096


def quality_weight(text: Column) -> Column:
    """Weight in [0.25, 1] from three rule statistics; 1 for plain prose.

    Shares of the text's characters that are symbols or digits (up to a tenth is free) and
    capitals (up to a fifth), and how far the mean word length lies outside 3 to 9.  Null
    and empty texts count as one word of one character.  No part is conditional, so that
    common parts are computed once.
    """
    t, words = F.coalesce(text, F.lit("")), F.greatest(word_count(text), F.lit(1))
    n = F.greatest(F.length(t), F.lit(1))
    odd = (F.length(t) - F.length(F.translate(t, "#*$%&|<>{}[]=_~^!0123456789", ""))) / n
    upper = (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / n
    mean = (n - words + 1) / words
    off = F.greatest(F.lit(3.0) - mean, mean - 9.0, F.lit(0.0))
    penalty = 3.0 * F.greatest(odd - 0.1, F.lit(0.0)) + 2.0 * F.greatest(upper - 0.2, F.lit(0.0)) + 0.1 * off
    return F.greatest(F.lit(0.25), F.lit(1.0) - penalty)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.  Windows here run over sources, not documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    per = per.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return per.withColumn("found", first_open.getField("level")).select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, quality: Column | None = None, seed: int = 7, bins: int = BINS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, epochs, taken.

    ``epochs`` is how often the mix takes the whole document, ``taken = epochs * size``.
    Null text has size 0; null sources form one source, the last; a source without words
    has target 0 and takes its documents no time.  Rows that repeat an id are decided one
    by one; rows equal in id and text share a key and are interchangeable.  A very long
    text is one unit: it is taken whole or not.  Columns other than doc_id, source
    and text are not read.  An empty table gives an empty result.
    """
    sized = _sized(docs.withColumn("__mix_row", F.monotonically_increasing_id()), quality, seed, bins)
    return _plan(sized, weights, share, max_epochs, bins).drop("__mix_row")


def _sized(docs: DataFrame, quality: Column | None, seed: int, bins: int) -> DataFrame:
    """Row, id, source, size and key of each document, staged: texts are read once and rows keep their numbers."""
    weight = quality if quality is not None else quality_weight(F.col("text"))
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.coalesce("text", F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    sized = docs.select("__mix_row", F.col("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), (-F.log(u) / weight).alias("key"))
    return stage(sized.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.lit(bins) * (F.lit(1.0) - F.exp(-F.col("key"))))).cast("int")), "mix")


def _plan(sized: DataFrame, weights, share: float, max_epochs: float, bins: int) -> DataFrame:
    targets = source_targets(sized, weights, share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    steps = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).withColumn("until", F.sum("bin_size").over(steps))
    filled = filled.withColumnRenamed("source", "b_source").join(targets, F.col("b_source").eqNullSafe(F.col("source")))
    cut = filled.groupBy("source", "source_size", "target", "whole", "rest").agg(F.min(F.when(F.col("until") > F.col("rest"), F.struct("bin", (F.col("until") - F.col("bin_size")).alias("before")))).alias("cut"))
    cut = cut.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "rest", F.coalesce("cut.bin", F.lit(bins)).alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("before"))

    rows = sized.join(cut, sized["source"].eqNullSafe(cut["t_source"]))
    inside = Window.partitionBy("source", "at_cut").orderBy("key", "doc_id", "size", "__mix_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sorted_rows = rows.filter("bin = cut_bin").withColumn("at_cut", F.lit(1)).withColumn("until", F.col("before") + F.sum("size").over(inside)).withColumn("drawn", F.col("until") <= F.col("rest")).drop("at_cut", "until")
    decided = rows.filter("bin <> cut_bin").withColumn("drawn", F.col("bin") < F.col("cut_bin")).unionByName(sorted_rows)

    # what the prefix leaves missing, and the document nearest to it
    missing = sorted_rows.groupBy("source").agg(F.max("rest").alias("m_rest"), F.max("before").alias("m_before"), F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("m_in"))
    missing = missing.select(F.col("source").alias("m_source"), (F.col("m_rest") - F.col("m_before") - F.col("m_in")).alias("missing"))
    open_rows = decided.filter(~F.col("drawn")).select("source", "doc_id", "size", "key", "__mix_row")
    best = open_rows.join(missing, F.col("source").eqNullSafe(F.col("m_source"))).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), "key", "doc_id", "size", "__mix_row", "missing")).alias("best"))
    best = best.filter("best.off < best.missing").select(F.col("source").alias("e_source"), F.col("best.__mix_row").alias("e_row"))
    out = decided.join(best, decided["source"].eqNullSafe(best["e_source"]), "left")
    extra = F.coalesce(F.col("e_row") == F.col("__mix_row"), F.lit(False))
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.col("whole") + (F.col("drawn") | extra).cast("long"))
    return out.select("__mix_row", "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), epochs.cast("long").alias("epochs"), (epochs * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, quality: Column | None = None, seed: int = 7, bins: int = BINS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Verdicts go to rows: the words of the result are ``sum(taken)`` also where ids repeat or
    are null.  Where no id does, an id is a row and docs is read again; it must give the
    same rows then.  Else the rows are staged whole, with a number each.
    """
    rows, at = docs, "doc_id"
    sized = _sized(docs.withColumn("__mix_row", F.monotonically_increasing_id()), quality, seed, bins)
    if not sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).filter("doc_id is null or times > 1").isEmpty():
        unstage(sized)
        rows, at = stage(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-rows"), "__mix_row"
        sized = _sized(rows, quality, seed, bins)
    plan = _plan(sized, weights, share, max_epochs, bins).filter("epochs > 0").select(F.col(at).alias("__mix_at"), F.col("epochs").alias("__mix_epochs"))
    joined = rows.join(plan, rows[at] == F.col("__mix_at"))
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_epochs")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "epochs")
