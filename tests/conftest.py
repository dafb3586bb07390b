import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("LOOMDEX_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def rows(spark):
    """A DataFrame of tuples with a schema; strings like 2025-01-02 become times."""

    def make(values, schema):
        times = [i for i, f in enumerate(schema.split(",")) if "timestamp" in f]
        fixed = [tuple(datetime.datetime.fromisoformat(v) if i in times and v else v for i, v in enumerate(r)) for r in values]
        return spark.createDataFrame(fixed, schema)

    return make
