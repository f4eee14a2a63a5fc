import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tieout.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture
def rows(spark):
    """rows("a int, b string", (1, "x"), …) -> DataFrame."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make
