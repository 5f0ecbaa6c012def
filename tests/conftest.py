import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from check import session

    # small limits, so that the paths for hot keys are taken on fixtures
    s = session("4", spark__spanaccord__hotRows="20", spark__sql__shuffle__partitions="8")
    yield s
    s.stop()


@pytest.fixture
def whole_keys(spark):
    """No key counts as hot inside the test."""
    spark.conf.set("spark.spanaccord.hotRows", "1000000000")
    yield
    spark.conf.set("spark.spanaccord.hotRows", "20")
