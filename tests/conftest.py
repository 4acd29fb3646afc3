from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from chronoweave.session import session

    made = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "3g"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
