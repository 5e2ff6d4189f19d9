import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lectern.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield s
    s.stop()
