from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("GAUGEWORKS_TESTDATA", "/root/testdata/sf0.01")


def build_session(checkpoint_dir: str) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("gaugeworks-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", checkpoint_dir)
        .config("spark.sql.warehouse.dir", f"{checkpoint_dir}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
