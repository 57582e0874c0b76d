"""Small frames with known results."""

import pytest

from stratum.operators import graph, maintain, modules, search


def test_budgeted_walk_on_a_cycle(spark):
    e = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")] + [("H", f"h{k:02}") for k in range(70)]
    edges = spark.createDataFrame([(a, b, "calls", "exact", f"{a}|{b}") for a, b in e], "src string, dst string, edge_type string, confidence_class string, id string")
    start = lambda n: spark.createDataFrame([(n,)], "node string")
    assert {(r.node, r.depth) for r in graph.traverse(edges, start("A"), 5).collect()} == {("A", 0), ("B", 1), ("C", 2), ("D", 3)}
    assert graph.traverse(edges, start("H"), 2, fanout=64).count() == 65
    stop = spark.createDataFrame([("C",)], "node string")
    assert {r.node for r in graph.traverse(edges, start("A"), 5, termini=stop).collect()} == {"A", "B", "C"}


def test_weakest_link_takes_the_best_parent(spark):
    rows = [("b", "a", "heuristic"), ("c", "a", "exact"), ("d", "b", "exact"), ("d", "c", "inferred")]
    edges = spark.createDataFrame(rows, "src string, dst string, confidence_class string")
    got = {r.node: r.weakest for r in graph.impact(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"a": 3, "b": 1, "c": 3, "d": 2}


def test_every_freshness_guard(spark):
    from pyspark.sql import functions as F

    states = ["fresh", "dirty-dependent", "stale"]
    df = spark.createDataFrame([(s,) for s in states], "s string")
    want = {"file": ["stale"] * 3, "evidence": ["stale", "dirty-dependent", "stale"], "commit": ["stale", "dirty-dependent", "stale"], "target": ["stale"] * 3, "fence": ["dirty-dependent", "dirty-dependent", "stale"], "restore": ["fresh", "fresh", "stale"]}
    for event, expected in want.items():
        got = {r.s: r.t for r in df.select("s", maintain.transition(F.col("s"), event, F.lit(True)).alias("t")).collect()}
        assert [got[s] for s in states] == expected


def test_stale_queue_arms(spark):
    items = spark.createDataFrame([("never", "h"), ("same", "h"), ("changed", "h2"), ("other", "h")], "id string, content_hash string")
    done = spark.createDataFrame([("same", "h", "m"), ("changed", "h1", "m"), ("other", "h", "x")], "id string, content_hash string, model string")
    assert {r.id for r in maintain.stale_queue(items, done, "id", "m").collect()} == {"never", "changed", "other"}


def test_clusters_tie_goes_to_the_first_pair(spark):
    refs = spark.createDataFrame([(a, b, "f") for a, b in [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")]], "source_module string, target_module string, file string")
    got = {r.module: r.cluster for r in modules.clusters(modules.dependencies(refs)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x", "y": "y"}


def test_refusal_is_not_an_empty_answer(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, body string")
    with pytest.raises(search.InvalidQuery):
        search.bm25(rows, "id", {"body": 1.0}, ["--"], every_term=True)


def test_order_of_input_does_not_matter(spark):
    rows = [(k, f"word{k % 3} other") for k in range(30)]
    one, two = (spark.createDataFrame(r, "id int, body string") for r in (rows, rows[::-1]))
    run = lambda df: sorted(map(tuple, search.bm25(df, "id", {"body": 1.0}, ["word1"], every_term=True).collect()))
    assert run(one) == run(two)


def test_query_grammar(spark):
    rows = [(1, "red fox runs", "a"), (2, "red dog", "fox"), (3, "the fox and the red hen", "b"), (4, "foxes", "c"), (5, None, None), (6, "runs red fox red fox", "d")]
    df = spark.createDataFrame(rows, "id int, body string, title string")
    columns = {"body": 1.0, "title": 2.0}
    found = search.index(df, "id", list(columns))
    ask = lambda q: {r.key for r in search.search(*found, columns, q).collect()}
    assert ask("red fox") == {1, 2, 3, 6} and ask('"red fox"') == {1, 6} and ask("fox*") == {1, 2, 3, 4, 6}
    assert ask("dog OR hen") == {2, 3} and ask("red NOT dog") == {1, 3, 6} and ask("red (dog OR runs)") == {1, 2, 6}
    assert ask("title: fox") == {2} and ask("body: (fox OR dog)") == {1, 2, 3, 6} and ask('"red fo"*') == {1, 6}
    best = search.search(*found, columns, '"red fox"').orderBy("rank").first()
    assert best.key == 6 and best.rank < 0
    for bad in ("", "  ", "(red", "red)", "OR", "red NOT", '"red', "nope: red", "--"):
        with pytest.raises(search.InvalidQuery):
            search.search(*found, columns, bad)


def test_anchor_terms():
    assert search.anchor_terms("How does the Payment gateway handle the payment?") == ["payment", "gateway", "handle"]
    assert search.anchor_terms("what is it") == ["what", "is", "it"]
    assert len(search.anchor_terms(" ".join(f"w{k}" for k in range(100)))) == 64


def test_index_and_scan_rank_alike(spark):
    df = spark.createDataFrame([(k, f"word{k % 3} other " * (k % 5)) for k in range(30)], "id int, body string")
    one = search.bm25_on(*search.index(df, "id", ["body"]), {"body": 1.0}, ["word1 other"], every_term=True)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, search.bm25(df, "id", {"body": 1.0}, ["word1 other"], every_term=True).collect()))


def test_interleave_takes_turns(spark):
    df = spark.createDataFrame([("a", 3), ("a", 9), ("a", 1), ("b", 5), ("c", 8), ("c", 2)], "repo string, score int")
    got = [(r.repo, r.score) for r in search.interleave(df, "repo", "score").orderBy("turn").collect()]
    assert got == [("a", 1), ("b", 5), ("c", 2), ("a", 3), ("c", 8), ("a", 9)]


def _graph(spark):
    e = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("A", "D")] + [("H", f"h{k:02}") for k in range(70)]
    edges = spark.createDataFrame([(a, b, "calls", "exact", f"{a}|{b}") for a, b in e], "src string, dst string, edge_type string, confidence_class string, id string")
    names = sorted({x for p in e for x in p})
    nodes = spark.createDataFrame([(n, "vendor" if n == "D" else "local") for n in names], "id string, origin string")
    return edges, nodes


def test_budgeted_walk_emits_edges_once_and_says_why_it_stopped(spark):
    edges, nodes = _graph(spark)
    walk = lambda start, direction="outgoing", dispatch=(), **b: graph.budgeted_walk(edges, nodes, start, graph.Budget(**b), direction, dispatch)
    found, emitted = walk("A", depth=5)
    assert [(x["id"], x["depth"], x["terminus"], x["external"]) for x in found] == [("A", 0, None, False), ("B", 1, None, False), ("D", 1, None, True), ("C", 2, None, False)]
    assert [(x["id"], x["revisit"]) for x in emitted] == [("A|B", False), ("A|D", False), ("B|C", False), ("C|A", True), ("C|D", True)]
    found, emitted = walk("A", depth=5, external=False)
    assert [x["id"] for x in found] == ["A", "B", "C"] and [x["id"] for x in emitted] == ["A|B", "B|C", "C|A"]
    found, emitted = walk("H", depth=2, fanout=64)
    assert len(found) == 65 and len(emitted) == 64 and found[0]["terminus"] == "fanout-cap"
    found, _ = walk("H", depth=2, nodes=10, fanout=64)
    assert len(found) == 10 and found[0]["terminus"] == "fanout-cap" or found[0]["terminus"] == "node-budget"
    assert {x["terminus"] for x in found[1:]} == {"leaf"}
    found, _ = walk("A", depth=1)
    assert [(x["id"], x["terminus"]) for x in found] == [("A", None), ("B", "depth-limit"), ("D", "depth-limit")]
    assert walk("A", depth=0)[0][0]["terminus"] == "depth-limit"


def test_dispatch_ends_forward_walks_only(spark):
    edges, nodes = _graph(spark)
    found, _ = graph.budgeted_walk(edges, nodes, "A", graph.Budget(depth=5), "outgoing", ("B",))
    assert [(x["id"], x["terminus"]) for x in found] == [("A", None), ("B", "dispatch"), ("D", None)]
    found, emitted = graph.budgeted_walk(edges, nodes, "B", graph.Budget(depth=5), "incoming", ("B",))
    assert {x["id"] for x in found} == {"A", "B", "C"} and {x["traversed"] for x in emitted} == {"reverse"}
    stop = spark.createDataFrame([("B",)], "node string")
    start = spark.createDataFrame([("D",)], "node string")
    assert {r.node for r in graph.traverse(edges, start, 5, "incoming", termini=stop).collect()} == {"A", "B", "C", "D"}


def test_clusters_merge_summed_neighbours_and_take_the_hub(spark):
    deps = spark.createDataFrame([("a", "x", 5), ("b", "x", 5), ("c", "y", 1), ("a", "b", 1)], "source_module string, target_module string, reference_count long")
    got = {r.module: (r.cluster, r.size, r.coupling_score) for r in modules.clusters(deps).collect()}
    assert set(got) == {"a", "b", "c", "x", "y"} and got["a"] == got["b"] and got["a"][1] >= 2
    lone = {r.module: r.cluster for r in modules.clusters(spark.createDataFrame([("p", "q", 1)], deps.schema)).collect()}
    assert lone == {"p": "p", "q": "q"}


def test_test_paths(spark):
    from pyspark.sql import functions as F

    from stratum.functions.text import is_test_path

    yes = ["tests/a.php", "src/__tests__/a.ts", "a\\test\\b.ts", "x.test.d.ts", "B.Spec.tsx", "Test.php", "UserTest.php", "TestCase.php", "FeatureTestCase.php"]
    no = ["", "app/Testing/T.php", "contest.php", "latest.php", "spec/a.ts", "UserTest.ts", "x.tests.ts"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in df.filter(is_test_path(F.col("p"))).collect()} == set(yes)
