"""Start streams on table files and publish what they produce."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quirekit.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Tables named ``name*.parquet`` in a folder, files or folders of part files, as a stream.

    ``files_per_trigger`` paces it (STM-07). A name filter would be held against the part files, so the path has the pattern.
    """
    pattern = f"{folder}/{name}*.parquet"
    reader = spark.readStream.schema(spark.read.parquet(pattern).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


#: Settings that keyed state with several variables and a time to live needs.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def state_store(spark: SparkSession, settle: bool = False) -> Iterator[None]:
    """RocksDB as state store for queries started inside; a query keeps what it was started with.

    State with a time to live always asks for one more batch without data, so a query that is to end must not run such
    batches. With ``settle`` they run: event time then goes on to the last watermark.
    """
    conf = {**STATE_CONF, NO_DATA: str(settle).lower()}
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_available(stream: DataFrame, folder: str, settle: bool = False) -> DataFrame:
    """Append everything available to parquet and read it back; ``settle`` lets timers in event time go off at the end.

    The checkpoint next to the output makes a restart go on where it stopped and
    publish every batch once (STM-10).
    """
    spark = stream.sparkSession
    with state_store(spark, settle):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_totals(stream: DataFrame, folder: str) -> DataFrame:
    """Run an aggregating stream and keep its latest totals: each batch rewrites them whole, so a replay changes nothing."""
    spark = stream.sparkSession

    def publish(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals")

    with state_store(spark):
        query = (
            stream.writeStream.outputMode("complete")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(publish)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/totals")
