"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest
from compare import check, duck

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, con, name):
    _, _, verdict = check(spark, con, SF, name, entry_module.queries()[name], entry_module.oracle_sql().get(name))
    assert verdict in ("ok", "rows-only"), verdict


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 0
