"""Module dependencies and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 5


def dependencies(refs: DataFrame) -> DataFrame:
    """source_module, target_module, reference_count, sample_files (first five, sorted).

    Files are reduced to one row per pair first, so no list grows with the references.
    """
    per_file = refs.groupBy("source_module", "target_module", "file").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source_module", "target_module").orderBy("file"))
    first = per_file.withColumn("k", rank).groupBy("source_module", "target_module").agg(
        F.sum("n").alias("reference_count"), F.array_sort(F.collect_list(F.when(F.col("k") <= SAMPLES, F.col("file")))).alias("sample_files")
    )
    return first


def blast_radius(deps: DataFrame) -> DataFrame:
    return deps.groupBy(F.col("target_module").alias("module")).agg(F.count(F.lit(1)).alias("dependents"), F.sum("reference_count").alias("total_references"))


def top_targets(deps: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source_module").orderBy(F.desc("reference_count"), "target_module"))
    return deps.withColumn("rank", rank).filter(F.col("rank") <= k).select("source_module", "target_module", "reference_count", "rank")


def coupling(deps: DataFrame) -> DataFrame:
    ends = deps.select(F.col("source_module").alias("module"), "reference_count").unionByName(deps.select(F.col("target_module").alias("module"), "reference_count"))
    return ends.groupBy("module").agg(F.sum("reference_count").alias("coupling"))


def neighbour_weights(deps: DataFrame) -> DataFrame:
    both = deps.select(F.col("source_module").alias("a"), F.col("target_module").alias("b"), "reference_count").unionByName(deps.select(F.col("target_module").alias("a"), F.col("source_module").alias("b"), "reference_count"))
    return both.groupBy("a", "b").agg(F.sum("reference_count").alias("w"))


def weighted_jaccard(deps: DataFrame) -> DataFrame:
    """Sum of minima over sum of maxima of neighbour weights, for module pairs that share a neighbour.

    ``sum(max) = total(a) + total(b) - sum(min)``, so only common neighbours are joined.
    """
    w = neighbour_weights(deps)
    total = w.groupBy("a").agg(F.sum("w").alias("t"))
    x, y = w.select(F.col("a").alias("p"), "b", F.col("w").alias("wp")), w.select(F.col("a").alias("q"), "b", F.col("w").alias("wq"))
    low = x.join(y, "b").filter("p < q").groupBy("p", "q").agg(F.sum(F.least("wp", "wq")).alias("low"))
    joined = low.join(total.select(F.col("a").alias("p"), F.col("t").alias("tp")), "p").join(total.select(F.col("a").alias("q"), F.col("t").alias("tq")), "q")
    return joined.select(F.col("p").alias("module_a"), F.col("q").alias("module_b"), F.round(F.col("low") / (F.col("tp") + F.col("tq") - F.col("low")), 6).alias("similarity"))


def clusters(deps: DataFrame, floor: float = 0.15) -> DataFrame:
    """module, cluster (its member of highest degree), size, coupling_score; every module once.

    Agglomerative merging: the most similar two clusters, by weighted Jaccard of their
    summed neighbour weights, are merged while the similarity reaches floor; ties go to
    the first pair in the order in which modules are first seen in the sorted
    dependencies.  Each merge depends on the one before, so this part is sequential.  The
    dependencies are one row per pair of modules, and are one group here.
    """
    import pandas as pd

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        weight: dict[str, dict[str, int]] = {}
        for a, b, n in sorted(zip(pdf.source_module, pdf.target_module, pdf.reference_count, strict=True)):
            for x, y in ((a, b), (b, a)):
                weight.setdefault(x, {})
                weight[x][y] = weight[x].get(y, 0) + int(n)
        members = {m: [m] for m in weight}
        around = {m: dict(weight[m]) for m in weight}  # neighbour weights of each cluster

        def similarity(x: str, y: str) -> float:
            p, q = around[x], around[y]
            low = sum(min(w, q[k]) for k, w in p.items() if k in q)
            high = sum(p.values()) + sum(q.values()) - low
            return low / high if high else 0.0

        order = list(members)
        known = {(x, y): similarity(x, y) for i, x in enumerate(order) for y in order[i + 1 :]}
        while known:
            best = max(known.values())
            if best < floor:
                break
            a, b = next(pair for pair in known if known[pair] == best)
            members[a] += members.pop(b)
            merged = around.pop(b)
            for k, w in merged.items():
                around[a][k] = around[a].get(k, 0) + w
            around[a] = {k: w for k, w in around[a].items() if k not in members[a]}
            known = {pair: s if a not in pair else similarity(*pair) for pair, s in known.items() if b not in pair}
        rows = []
        for group in members.values():
            group = sorted(group)
            hub = min(group, key=lambda m: (-sum(weight[m].values()), m))
            score = sum(weight[x].get(y, 0) for x in group for y in group if x < y)
            rows += [(m, hub, len(group), score) for m in group]
        return pd.DataFrame(rows, columns=["module", "cluster", "size", "coupling_score"])

    pairs = deps.select("source_module", "target_module", "reference_count").withColumn("one", F.lit(1))
    return pairs.groupBy("one").applyInPandas(merge, "module string, cluster string, size long, coupling_score long")


def dependencies_only(refs: DataFrame) -> DataFrame:
    """source_module, target_module, reference_count: a plain count, without samples."""
    return refs.groupBy("source_module", "target_module").agg(F.count(F.lit(1)).alias("reference_count"))
