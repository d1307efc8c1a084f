import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """Builds a page table from ``url, html`` and optional status and content type."""

    def build(*rows):
        full = [
            (url, rest[0] if rest else 200, rest[1] if len(rest) > 1 else "text/html", html, None)
            for url, html, *rest in rows
        ]
        return spark.createDataFrame(
            full, "url string, status int, content_type string, html string, fetched_at timestamp"
        )

    return build
