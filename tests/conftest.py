import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("vitrine-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate column functions over single values: values(fn, *inputs) -> list."""
    def run(function, *inputs, kind="string"):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]
    return run


@pytest.fixture
def page(spark):
    """One captured page."""
    def make(body, store="s", kind="html", rank=0, batch=1):
        return spark.createDataFrame(
            [(batch, store, "https://feed/x", rank, None, kind, body)],
            "batch_id long, store string, page_url string, page_rank int, fetched_at timestamp, kind string, body string")
    return make
