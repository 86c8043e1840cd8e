from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import odd  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return odd.documents(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return odd.empty(spark)


@pytest.fixture(scope="session")
def table(spark):
    """A stored table and its rows."""

    def read(name):
        frame = spark.read.parquet(f"{SF}/{name}.parquet")
        return frame, frame.collect()

    return read
