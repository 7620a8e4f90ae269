"""Every registered query beside its SQL, on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.compare import differences, oracle_connection

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
