"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, oracle_connection

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_every_query_has_sql():
    """Of the text operators, those that SQL can't express are tested beside them."""
    own = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["log_group", "log_stream", "n_events", "n_bytes", "first_ts_ms", "last_ts_ms"]
    assert df.count() > 0
