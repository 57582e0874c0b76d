"""Bounded graph walks as level loops of joins.

Each level joins the frontier with the edges, keeps at most ``fanout`` edges per node
(by id), and drops visited nodes.  Frontiers are written to the shared folder, so lineage
does not grow with depth.

Edges are a frame, or a source: a function of nodes and a side (src or dst) that gives the
edges at those nodes, so that no others need to be computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.sources.stored import write

RANK = {"heuristic": 1, "inferred": 2, "exact": 3}


def class_rank(column: str = "confidence_class"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col(column))


Edges = DataFrame | Callable[[DataFrame, str], DataFrame]


def at(edges: Edges, ends: DataFrame, side: str) -> DataFrame:
    """The edges whose ``side`` is a node of ends."""
    return edges.join(ends.select(F.col("node").alias(side)), side, "left_semi") if isinstance(edges, DataFrame) else edges(ends, side)


def chosen(edges: DataFrame, edge_types: list[str] | tuple[str, ...] | None, least_class: str | None) -> DataFrame:
    if edge_types is not None:
        edges = edges.filter(F.col("edge_type").isin(*edge_types))
    return edges.filter(class_rank() >= RANK[least_class]) if least_class else edges


SIDES = {"outgoing": [("src", "dst")], "incoming": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}


def traverse(edges: Edges, starts: DataFrame, depth: int, direction: str = "outgoing", fanout: int | None = None, edge_types: list[str] | None = None, least_class: str | None = None, termini: DataFrame | None = None) -> DataFrame:
    """node, depth (least number of hops), without a node budget.

    Termini are recorded and never expanded forwards; a walk against the edges passes
    them.  The frontier is joined first, so fan-out is ranked among its edges only.
    """
    def steps(ends: DataFrame) -> DataFrame:
        ways = [chosen(at(edges, ends, near), edge_types or None, least_class).select(F.col(near).alias("from_id"), F.col(far).alias("to_id"), *(["id"] if fanout else [])) for near, far in SIDES[direction]]
        return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])

    seen = write(starts.select(F.col("node"), F.lit(0).alias("depth")), "seen")
    frontier = seen.select("node")
    for level in range(1, depth + 1):
        open_nodes = frontier if termini is None or direction == "incoming" else frontier.join(termini, "node", "left_anti")
        reached = steps(open_nodes)
        if fanout:
            order = Window.partitionBy("from_id").orderBy("id")
            reached = reached.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= fanout)
        # a written frontier has a known size: the planner sends it to the edges while it is small
        frontier = write(reached.select(F.col("to_id").alias("node")).distinct().join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return seen


def impact(edges: Edges, seeds: DataFrame, depth: int) -> DataFrame:
    """Reverse walk with the weakest link of the best path: node, depth, weakest (rank of the class).

    A node's value is fixed at its first level: the best over its parents of
    min(parent's value, edge's rank).
    """
    seen = write(seeds.select("node", F.lit(0).alias("depth"), F.lit(max(RANK.values())).alias("weakest")), "seen")
    frontier = seen
    for level in range(1, depth + 1):
        steps = at(edges, frontier, "dst").select(F.col("dst").alias("from_id"), F.col("src").alias("to_id"), class_rank().alias("r"))
        reached = steps.join(frontier.select("node", "weakest"), F.col("node") == F.col("from_id")).groupBy("to_id").agg(F.max(F.least("weakest", "r")).alias("weakest"))
        reached = reached.select(F.col("to_id").alias("node"), F.lit(level).alias("depth"), "weakest")
        frontier = write(reached.join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


@dataclass(frozen=True)
class Budget:
    """Limits of a budgeted walk; what is collected is at most ``nodes * (fanout + 1)`` edges a level."""

    depth: int = 3
    nodes: int = 500
    fanout: int = 64
    least_class: str = "heuristic"
    edge_types: tuple[str, ...] | None = None
    external: bool = True


def budgeted_walk(edges: Edges, nodes: DataFrame, start: str, budget: Budget, direction: str = "outgoing", dispatch: tuple[str, ...] = ()) -> tuple[list[dict], list[dict]]:
    """Nodes (id, depth, terminus, external) and emitted edges (id, traversed, revisit) of one bounded walk.

    Frontier nodes are taken in the order in which they were admitted, their edges by id;
    each node walks its first ``fanout`` edges that have not been emitted; an edge is
    emitted once in each direction; the walk ends at the first node that the budget has
    no room for.  Dispatch nodes end forward walks and are passed backwards.  The budget
    bounds every frontier, so one level is a scan for a few sources with a ranked limit
    per source, and admission, which is sequential by definition, runs on its result.
    """
    spark = nodes.sparkSession

    def around(ids: list[str], near: str, far: str, traversed: str) -> DataFrame:
        ends = F.broadcast(spark.createDataFrame([(x,) for x in ids], "node string"))  # at most budget.nodes rows
        own = chosen(at(edges, ends, near), budget.edge_types, budget.least_class)
        return own.select(F.col(near).alias("at"), F.col(far).alias("to"), "id", F.lit(traversed).alias("traversed"))

    found = {start: {"id": start, "depth": 0, "terminus": None, "external": False}}
    emitted: list[dict] = []
    used: set[tuple[str, str]] = set()
    expanded: set[str] = set()
    frontier = [start]
    if start in dispatch and direction == "outgoing":
        found[start]["terminus"], frontier = "dispatch", []
    elif budget.depth == 0:
        found[start]["terminus"], frontier = "depth-limit", []
    full = False
    for level in range(1, budget.depth + 1):
        if not frontier or full:
            break
        sides = []
        if direction in ("outgoing", "both"):
            ahead = [x for x in frontier if not (x in dispatch and direction == "both")]
            sides.append(around(ahead, "src", "dst", "forward"))
        if direction in ("incoming", "both"):
            sides.append(around(frontier, "dst", "src", "reverse"))
        steps = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        if used:
            done = spark.createDataFrame(sorted(used), "id string, traversed string")
            steps = steps.join(F.broadcast(done), ["id", "traversed"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("at").orderBy("id", "traversed"))
        steps = steps.withColumn("k", rank).filter(F.col("k") <= budget.fanout + 1)
        far = nodes.select(F.col("id").alias("to"), (F.col("origin") != "local").alias("external"))
        by_node: dict[str, list] = {}
        for r in sorted(steps.join(far, "to", "left").collect(), key=lambda r: r.k):
            by_node.setdefault(r["at"], []).append(r)
        following: list[str] = []
        for node in frontier:
            if full:
                break
            expanded.add(node)
            own = [r for r in by_node.get(node, []) if (r.id, r.traversed) not in used]
            if len(own) > budget.fanout:
                found[node]["terminus"] = "fanout-cap"
            for r in own[: budget.fanout]:
                if r.external and not budget.external:
                    continue
                again = r.to in found
                if not again and len(found) >= budget.nodes:
                    found[node]["terminus"], full = "node-budget", True
                    break
                emitted.append({"id": r.id, "traversed": r.traversed, "revisit": again})
                used.add((r.id, r.traversed))
                if again:
                    continue
                found[r.to] = {"id": r.to, "depth": level, "terminus": None, "external": bool(r.external)}
                if r.traversed == "forward" and r.to in dispatch:
                    found[r.to]["terminus"] = "dispatch"
                elif level == budget.depth:
                    found[r.to]["terminus"] = "depth-limit"
                else:
                    following.append(r.to)
        frontier = following
    for x in found.values():
        if x["terminus"] is None and x["id"] not in expanded and x["depth"] < budget.depth:
            x["terminus"] = "leaf"
    return sorted(found.values(), key=lambda x: (x["depth"], x["id"])), emitted


def without_lone_heuristics(edges: DataFrame) -> DataFrame:
    """Heuristic edges stay only where another edge joins the same pair."""
    firm = edges.filter("confidence_class <> 'heuristic'")
    return firm.unionByName(edges.filter("confidence_class = 'heuristic'").join(firm.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select(*edges.columns))
