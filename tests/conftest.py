import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from matchloom.session import build_session  # noqa: E402


def pytest_collection_modifyitems(items):
    """Stand-in transports live in test modules; workers get them by value."""
    for module in {item.module for item in items}:
        cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
