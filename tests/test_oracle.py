"""Every query of the catalog against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from seqweave.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(table):
    names = sorted(table.column_names)

    def value(x):
        return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)

    return names, sorted(tuple(value(x) for x in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(ORACLE[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
