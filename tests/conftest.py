import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def pair(spark, sf):
    from workload.fixtures import orders_target, table
    return table(spark, sf, "orders").cache(), orders_target(spark, sf).cache()


@pytest.fixture(scope="session")
def column(spark):
    """A one-column DataFrame of the given values."""
    def build(values, name="v", kind="double"):
        return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return build


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()
