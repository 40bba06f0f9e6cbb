"""Every query of the core that has SQL gives what the SQL gives, and the others give rows."""

import os

import pytest

from oracle import compare, connection
from quern.plans import core, engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("part,name", [(p, n) for p in (engine, core) for n in p.SQL])
def test_query_equals_its_sql(spark, con, part, name):
    compare(spark, con, part, name, SF)


def test_queries_without_sql_run(spark):
    for part in (engine, core):
        for name in part.QUERIES.keys() - part.SQL.keys():
            assert part.QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "rank" or "rank" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
