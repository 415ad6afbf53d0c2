import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("logcompact-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """Lines of several runs from {run_id: text}."""

    def make(texts: dict[int, str]):
        rows = [
            (run, number + 1, line)
            for run, text in texts.items()
            for number, line in enumerate(text.split("\n") if text else [])
        ]
        return spark.createDataFrame(rows, "run_id BIGINT, line_no BIGINT, text STRING")

    return make


@pytest.fixture
def rendered():
    """Output lines per run in order."""

    def make(rows, order="pos"):
        out: dict[int, list[str]] = {}
        for row in sorted(rows.collect(), key=lambda r: (r["run_id"], r[order])):
            out.setdefault(row["run_id"], []).append(row["text"])
        return out

    return make
