import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

TEXTS = "doc_id long, text string, left string, rk long, leaks string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) rows, with further columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], TEXTS)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
