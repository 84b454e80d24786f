import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from gleanboard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def texts(spark):
    """A one-column table of strings with their position."""
    def build(*values):
        return spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return build


@pytest.fixture
def column_of(texts):
    """Values of an expression over strings, in order."""
    def values(expression, *inputs):
        from pyspark.sql import functions as F
        rows = texts(*inputs).select("i", expression(F.col("t")).alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]
    return values
