import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnmill.session import configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def parsed(spark):
    """Rows ``(id, v)`` from Python objects or JSON texts."""
    from pyspark.sql import functions as F

    from turnmill.sources.records import parse_lines

    def build(records):
        texts = [r if isinstance(r, str) else json.dumps(r) for r in records]
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
        return parse_lines(rows).filter(F.col("problem").isNull()).drop("problem")

    return build


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
