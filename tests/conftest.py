from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helpers import BASKETS, BRIDGE, FAVOURITES, ITEMS, STOCK, table  # noqa: E402
from workload.compare import test_session as start_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = start_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    return {
        "items": table(spark, "items", ITEMS).cache(),
        "baskets": table(spark, "baskets", BASKETS).cache(),
        "bridge": table(spark, "bridge", BRIDGE).cache(),
        "stock": table(spark, "stock", STOCK).cache(),
        "favourites": table(spark, "favourites", FAVOURITES).cache(),
    }
