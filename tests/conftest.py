import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pageloom.session import tune

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    """Build a pages table from html strings (or (url, html) pairs)."""

    def build(*pages):
        rows = []
        for i, p in enumerate(pages):
            url, html = p if isinstance(p, tuple) else (f"https://h.example/p/{i}", p)
            rows.append((i, url, html))
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return build
