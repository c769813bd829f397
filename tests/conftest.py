import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecspark.session import local_session  # noqa: E402

# Column constants in test parameters need a running session.
SESSION = local_session("tests", cores=8)
SESSION.sparkContext.setLogLevel("ERROR")

EMB = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(EMB)


def value(spark, column):
    """The value of a constant expression."""
    return spark.range(1).select(column.alias("x")).first()[0]


def error_of(spark, column) -> str:
    with pytest.raises(Exception) as caught:
        value(spark, column)
    return str(caught.value)
