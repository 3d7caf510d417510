import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from farfield.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def points(spark):
    def make(rows):
        return spark.createDataFrame(
            [(i, [float(v) for v in x]) for i, x in enumerate(rows)], "i bigint, x array<double>"
        )

    return make
