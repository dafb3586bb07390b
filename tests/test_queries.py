"""Every core query against its SQL on the smallest tables."""

import pytest

from loomdex.plans import general, index_queries, stored_queries
from tests.oracle import canonical, connect

QUERIES = {**general.QUERIES, **index_queries.QUERIES, **stored_queries.QUERIES}
ORACLE = {**general.ORACLE, **index_queries.ORACLE, **stored_queries.ORACLE}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_without_sql_runs(spark, data):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, data).count() > 0


def test_semi_and_anti_part_the_references(spark, data):
    n = {k: QUERIES[k](spark, data).count() for k in ("ref_semi", "sym_anti")}
    from loomdex.sources.index import references

    assert sum(n.values()) == references(spark, data).count() and all(n.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_lookups_reach_the_files(spark, data):
    def plan(name):
        return QUERIES[name](spark, data)._jdf.queryExecution().toString()

    assert "EqualTo(key,base_read)" in plan("def_exact")
    assert "StringStartsWith(key,read_)" in plan("def_prefix")
    assert "CartesianProduct" not in plan("p5_found")
