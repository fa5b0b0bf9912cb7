"""Every registered query against DuckDB on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
OWN_TESTS = {name for name in entry.queries() if name == "pipeline" or name.startswith("op")}  # corpus queries, tested beside their operators


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).columns == ["state", "transfer_class", "n", "mean_z", "min_z", "max_z"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    problem, _ = differences(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - OWN_TESTS))
def test_runs(spark, name):
    rows = entry.queries()[name](spark, SF_DIR).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
