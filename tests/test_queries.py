"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewell.plans import registry

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("set TimeZone='UTC'")
    for name in os.listdir(TABLES):
        at = f"{TABLES}/{name}"
        made.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return made


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.isoformat()[:19] if hasattr(x, "isoformat") else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    found = QUERIES[name](spark, TABLES)
    columns = sorted(found.columns)
    want = con.execute(SQL[name])
    there = [c[0] for c in want.description]
    assert sorted(there) == columns
    expected = sorted(str([plain(r[there.index(c)]) for c in columns]) for r in want.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in found.collect()) == expected


def test_tied_means_of_the_matrix_are_rounded_as_by_its_sql(spark):
    """Ten means of sf0.1 tie at the seventh place. DuckDB adds them up in one order on one thread only."""
    tables = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'; set threads=1")
    con.execute(f"create view events as select * from '{tables}/events.parquet'")
    want = {user: features for user, _, features in con.execute(SQL["m20_combined_matrix"]).fetchall()}
    found = {r["user"]: [float(f"{x:.9g}") for x in r["features"]] for r in QUERIES["m20_combined_matrix"](spark, tables).collect()}
    assert len(found) == 900 and found == {user: [float(f"{x:.9g}") for x in v] for user, v in want.items()}


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["a6_pca_projection", "m10_bootstrap_ci", "m11_evaluate_predictions"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, TABLES).count()
