"""Every registered query against its SQL twin at the smallest scale, and the driver contract."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck
from skein.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"html_elements", "html_chunks", "communities", "graph_analysis", "search_work"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    assert "CartesianProduct" not in plan.getvalue() and "NestedLoopJoin" not in plan.getvalue()
    rows = df.collect()
    if name in entry.oracle_sql():
        result = con.execute(entry.oracle_sql()[name])
        assert compare(df.columns, rows, [d[0] for d in result.description], result.fetchall()) == ""
    else:
        assert rows
