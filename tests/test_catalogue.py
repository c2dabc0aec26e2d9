"""Every catalogue query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera import queries as catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def shown(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple("-" if r[i] is None else f"{float(r[i]):.9g}" if isinstance(r[i], (int, float)) else shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_scans_are_pruned_and_filters_pushed_down(spark):
    plan = catalogue.queries()["filter_project"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]
