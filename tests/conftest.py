import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from fleetwitness.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Every group above five rows counts as hot."""
    spark.conf.set("spark.fleetwitness.hotGroupRows", "5")
    yield
    spark.conf.unset("spark.fleetwitness.hotGroupRows")
