"""One Spark session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from rillgrid.session import session

    made = session(cpus=4, partitions=4, app="tests", spark__sql__adaptive__coalescePartitions__enabled="true")
    yield made
    made.stop()
