import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagelake.session import SETTINGS

    builder = SparkSession.builder.master("local[8]").appName("tests")
    settings = {
        **SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def column(spark):
    """Apply a Column function to string values and return the results."""
    def run(values, fn):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def page_df(spark):
    """Pages from (url, html) pairs."""
    def make(*rows):
        from pagelake.sources.pages import scan_pages

        return scan_pages(spark.createDataFrame(list(rows), "url string, html string"))

    return make
