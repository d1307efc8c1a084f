import os

import pytest

SMALL = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, tag string, node long, key long, part int, place long"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(*rows):
        return spark.createDataFrame([(k, t, "x", 1, 2, 3, 4) for k, t in rows], CLASHING)

    return build


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
