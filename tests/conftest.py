import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aisle.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def hot(spark):
    """Treat every group of at least three rows as hot, so the salted paths run."""
    spark.conf.set("spark.aisle.hotGroupRows", "3")
    yield
    spark.conf.unset("spark.aisle.hotGroupRows")
