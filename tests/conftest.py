import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def files(spark):
    """(repo, branch, commit, path, content) from {path: content} or {(repo, path): content}."""

    def make(contents: dict, commit: str = "c1"):
        rows = [(k[0] if isinstance(k, tuple) else "shop", "main", commit, k[1] if isinstance(k, tuple) else k, v) for k, v in contents.items()]
        return spark.createDataFrame(rows, "repo string, branch string, commit string, path string, content string")

    return make
