import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from conftest_rows import SCHEMA, messy_rows


@pytest.fixture(scope="session")
def messy(spark):
    rows, _ = messy_rows()
    wide = [(*r, None if r[1] is None else len(r[1]), 1, "s", "x", "c", 2, "b", "m", 1, "p", 3) for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
