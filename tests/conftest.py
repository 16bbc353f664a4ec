from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lessonloom.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def texts(spark):
    """``texts(["a", "b"])``: a table of documents numbered from 0."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "doc_id INT, text STRING")

    return make


@pytest.fixture
def value(spark):
    """The value of a column expression over one row with column ``x``."""

    def make(expression, x):
        df = spark.createDataFrame([(x,)], "x STRING")
        return df.select(expression.alias("v")).first()["v"]

    return make
