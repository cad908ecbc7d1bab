"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

from evmatch import queries, scale, semantics  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    expected = duck.execute(queries.ORACLES[name])
    order = sorted(range(len(got.columns)), key=lambda k: got.columns[k])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    back = [columns.index(got.columns[k]) for k in order]
    assert sorted(str([r[k] for k in order]) for r in got.collect()) == sorted(str([r[k] for k in back]) for r in expected.fetchall())


def test_items_are_dealt_before_they_are_listed(spark):
    """A list of one item each is no less to move, and making it is a sort of its own."""
    from evmatch.queries import orders_with_items

    plan = orders_with_items(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("ObjectHashAggregate") < plan.index("Exchange hashpartitioning(l_orderkey")
