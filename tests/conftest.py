import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rivulint.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("rivulint-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Builds a corpus frame from (path, content) pairs."""

    def build(*files):
        return spark.createDataFrame(list(files), "path string, content string")

    return build
