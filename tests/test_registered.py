"""The registered queries against their SQL on the smallest tables (all of them: check.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
import check

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "domains",
    "tway_tuples",
    "tway_tuples_sliding",
    "tway_coverage",
    "missing_tuples",
    "incidence_rows",
    "conflict_graph",
    "adjacency",
    "hyperedge_files",
    "graphviz_files",
    "dimacs_strings",
    "result_files",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the driver tables are not here")
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    """The corpus queries may do without, and are tested against plain versions then."""
    named = registered.oracle_sql().keys()
    assert registered.QUERIES.keys() <= named <= registered.queries().keys()


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    good, text = check.compare(spark, con, SF_DIR, name)
    assert good, text
