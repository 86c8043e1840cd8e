from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quirekit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "quirekit-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to a list of strings."""
    from pyspark.sql import functions as F

    def run(fn, values):
        frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        rows = frame.select("i", fn(F.col("v")).alias("r")).collect()
        return [row.r for row in sorted(rows, key=lambda row: row.i)]

    return run
