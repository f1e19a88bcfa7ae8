import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=8, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def crowded(spark):
    """Treat any key with more than three rows as hot, so that every spread path is taken."""
    spark.conf.set("shelfmark.rowsPerTask", "3")
    yield spark
    spark.conf.unset("shelfmark.rowsPerTask")
