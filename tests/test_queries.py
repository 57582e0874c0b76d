"""Every query with SQL agrees with it on the smallest tables."""

import pytest
from compare import connect, differences

from stratum.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_snippets_show_and_mark_the_hit(spark, tmp_path):
    late = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "an idiot, they said"), (2, late + " two idiots. End"), (3, '"Idiot!" (x)'), (4, "such IDÏOT\ntalk"), (5, "nothing"), (6, None), (7, late + ",idiot-like")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.snippet for r in registry.QUERIES["snippets"](spark, str(tmp_path)).collect()}
    assert got == {
        1: "an <mark>idiot</mark>, they said", 2: "w26 w27 w28 w29 two <mark>idiots</mark>. End", 3: '"<mark>Idiot</mark>!" (x)',
        4: "such <mark>IDÏOT</mark> talk", 7: "w25 w26 w27 w28 w29,<mark>idiot</mark>-like",
    }
