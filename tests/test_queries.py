import pytest
from compare import connect, differences

from svspark.plans.oracles import ORACLE_SQL
from svspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_and_linkage_equal_union_find(spark):
    for name, edges in (("linkage_clusters", None),):
        got = {r.prediction_id: r.component for r in QUERIES[name](spark, SF).collect()}
        from svspark.plans.queries import _ends

        rows = _ends(spark, SF).collect()
        parent = {r.prediction_id: r.prediction_id for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        by = {}
        for r in rows:
            by.setdefault(r.chromosome_1, []).append(r)
        for part in by.values():
            for i, a in enumerate(part):
                for b in part[i + 1 :]:
                    if (a.position_1 - b.position_1) ** 2 + (a.position_2 - b.position_2) ** 2 < 300**2:
                        x, y = sorted((find(a.prediction_id), find(b.prediction_id)))
                        parent[y] = x
        assert got == {k: find(k) for k in parent}


def test_set_cover_is_complete_and_greedy(spark):
    from svspark.operators.graph import set_cover

    members = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (4, "z"), (5, "z")]
    weights = [(1, 1.0), (2, 1.0), (3, 2.0), (4, 1.0), (5, 0.5)]
    got = {(r.set_id, r.element) for r in set_cover(spark.createDataFrame(members, "set_id long, element string"), spark.createDataFrame(weights, "set_id long, weight double")).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "c"), (5, "z")}
