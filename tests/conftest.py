import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session(8, "millrace-tests", "4g")
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of plain values."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
