"""Parquet tables, spread over the cores when a scan is too narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirekit.session import bounded_batches


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; what is sent of it to Python workers goes in batches of bounded bytes."""
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the cores when the scan has fewer splits than cores.

    One small file is one task, which starves row-local text work. Large inputs
    already have more splits than cores, so they get no shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, *keys)
