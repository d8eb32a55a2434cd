import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postlens.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.log.level": "OFF"}
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect rows as plain tuples, sorted."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    return collect
