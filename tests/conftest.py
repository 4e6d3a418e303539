import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stowage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A small DataFrame from tuples and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
