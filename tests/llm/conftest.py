import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import EXTRA, SCHEMA, sample_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    frame = spark.createDataFrame([(*r, *["?"] * len(EXTRA)) for r in rows], SCHEMA)
    return frame.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
