from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)

from corpus import CORPUS, QUERIES  # noqa: E402
from siftwell import runtime  # noqa: E402
from siftwell.sources import documents as src  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    runtime.ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    return runtime.write_scratch(src.inline_documents(spark, CORPUS), "test-docs")


@pytest.fixture(scope="session")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string, category string")
