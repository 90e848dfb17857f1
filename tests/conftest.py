import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Literal rows -> DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
