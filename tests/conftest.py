import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fleetlake.session import build_session

    session = build_session(
        "fleetlake-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tmp_dir():
    """A fresh folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="fleetlake-test-")
