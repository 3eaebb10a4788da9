import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("latticemix-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from latticemix.session import remove_intermediate

    remove_intermediate(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    from fixtures import SF_DIR

    if not os.path.isdir(SF_DIR):
        pytest.skip(f"{SF_DIR} not found")
    return SF_DIR
