"""What keeps large inputs within limits, seen on small frames: what a plan exchanges, what a walk reads."""

import re
from pathlib import Path

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from stratum.operators import graph, search
from stratum.plans import graphs
from stratum.sources import stored, tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_exchanges_rows_not_postings(spark):
    rows = spark.createDataFrame([(k, f"Été red {k % 3} red", "src") for k in range(40)], "id int, body string, title string")
    postings, stats = search.index(rows, "id", ["body", "title"], 5)
    plan = plan_of(postings)
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    parts = postings.withColumn("part", F.spark_partition_id()).collect()
    assert max(len({r.part for r in parts if r.key == k}) for k in range(40)) == 1
    for p in {r.part for r in parts}:
        terms = [(r.term, r.key) for r in parts if r.part == p]
        assert terms == sorted(terms)
    assert sorted((r.term, r.col, r.pos, r.d) for r in parts if r.key == 4) == [("1", "body", 2, 5), ("ete", "body", 0, 5), ("red", "body", 1, 5), ("red", "body", 3, 5), ("src", "title", 0, 5)]
    assert [tuple(r) for r in search.statistics(rows, postings).collect()] == [tuple(r) for r in stats.collect()] == [(40, 5.0)]
    assert [tuple(r) for r in search.statistics(rows.limit(0), postings.limit(0)).collect()] == [(0, None)]


def test_words_alone_are_counted_without_positions(spark):
    rows = spark.createDataFrame([(k, "red fox red " * k) for k in range(1, 9)], "id int, body string")
    found = search.index(rows, "id", ["body"])
    assert "collect_list" not in plan_of(search.search(*found, {"body": 1.0}, "red AND fo*"))
    assert "collect_list" in plan_of(search.search(*found, {"body": 1.0}, 'fox "red fox"'))
    both = {r.key: r.rank for r in search.search(*found, {"body": 1.0}, 'red "red red" fo*').collect()}
    assert set(both) == set(range(2, 9))


def test_edges_at_nodes_are_those_of_all_edges(spark):
    names = ["order:1", "order:01", "order:2x", "order:", "order:-1", "part:3", "supplier:2", "customer:7", "nation:3", "region:1", "x", None]
    ends = spark.createDataFrame([(n,) for n in names], "node string")
    every, source = tables.edges(spark, SF), tables.edges_at(spark, SF)
    for side in ("src", "dst"):
        got, want = source(ends, side), graph.at(every, ends, side).select(*every.columns)
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.collect())) and {r[0 if side == "src" else 1] for r in rows} <= set(names) and rows


def test_walks_ask_for_their_frontiers_only(spark):
    e = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("X", "Y")]
    edges = spark.createDataFrame([(a, b, "calls", "exact", f"{a}|{b}") for a, b in e], "src string, dst string, edge_type string, confidence_class string, id string")
    asked: list[tuple[str, set]] = []

    def source(ends, side):
        asked.append((side, {r.node for r in ends.collect()}))
        return graph.at(edges, ends, side)

    start = spark.createDataFrame([("A",)], "node string")
    assert {(r.node, r.depth) for r in graph.traverse(source, start, 2, "both").collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2)}
    assert asked == [("src", {"A"}), ("dst", {"A"}), ("src", {"B", "C"}), ("dst", {"B", "C"})]
    asked.clear()
    assert {r.node for r in graph.impact(source, start, 2).collect()} == {"A", "C", "B"} and asked == [("dst", {"A"}), ("dst", {"C"})]
    asked.clear()
    nodes = spark.createDataFrame([(n, "local") for n in "ABCDXY"], "id string, origin string")
    found, _ = graph.budgeted_walk(source, nodes, "A", graph.Budget(depth=2))
    assert [x["id"] for x in found] == ["A", "B", "C"] and asked == [("src", {"A"}), ("src", {"B"})]


def test_graph_queries_store_no_edges(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir")) / "stratum-tables"
    for name in ("trust_summary", "trace_both", "operational_neighborhood", "impact_walk", "one_hop_downstream", "federated_trace"):
        graphs.Q[name](spark, SF).count()
    assert not [p for p in folder.iterdir() if p.name.startswith(("edges-", "incoming-"))]
    # one exchange of line items for each of the two edge types that have several sources, one of what each task has summed
    assert plan_of(graphs.trust_summary(spark, SF)).count("Exchange") == 3


def test_one_task_for_each_share_of_lineitem(spark, monkeypatch):
    monkeypatch.setattr(stored, "SHARE_BYTES", 4096)
    n = stored.shares(tables.load(spark, SF, "lineitem"))
    assert n > 8
    for name, most in (("dependents_rollup", 3), ("glue_projection", 6)):
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(graphs.Q[name](spark, SF)))
        by_key = [x for x in dealt if re.match(r"l_", x)]
        assert by_key and all(x.endswith(f", {n}") for x in by_key) and len(by_key) <= most


@pytest.mark.parametrize("name", ["dependents_rollup", "glue_projection", "boundary_aggregates", "region_summaries", "trust_summary"])
def test_odd_rows_agree_with_sql(spark, tmp_path, name):
    """Repeated orders, customers and suppliers, missing ones, and keys without a value."""
    con = connect(SF)
    extra = {
        "orders": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey < 40 UNION ALL SELECT * REPLACE (o_custkey + 1 AS o_custkey) FROM orders WHERE o_orderkey BETWEEN 20 AND 60 UNION ALL SELECT * REPLACE (NULL AS o_custkey) FROM orders WHERE o_orderkey BETWEEN 50 AND 80",
        "customer": "SELECT * FROM customer WHERE c_custkey > 5 UNION ALL SELECT * FROM customer WHERE c_custkey BETWEEN 10 AND 14 UNION ALL SELECT * REPLACE (NULL AS c_nationkey) FROM customer WHERE c_custkey = 20",
        "supplier": "SELECT * FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT * FROM supplier WHERE s_suppkey = 4",
        "lineitem": "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey < 300 UNION ALL SELECT * REPLACE (999999 AS l_orderkey) FROM lineitem WHERE l_orderkey < 9",
        "nation": "SELECT * FROM nation",
    }
    for t, sql in extra.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    assert differences(graphs.Q[name](spark, str(tmp_path)), connect(str(tmp_path)), graphs.SQL[name]) == []
