import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from webloom.runtime import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.codegen.factoryMode": "FALLBACK"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
