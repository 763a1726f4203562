"""Every named query with SQL gives the same rows as that SQL; the others run and yield rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from check import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="benchmark tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    outcome = compare(spark, con, name, queries()[name], oracle_sql().get(name), ROOT)
    assert outcome.startswith(("ok", "rows only")) and "TYPES" not in outcome, outcome


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(oracle_sql()) <= set(queries())
