"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows carry whole texts: keep Arrow batches small enough for long ones.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


#: Bytes of a batch sent to a Python worker; one longer row still makes a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes, since texts differ a thousandfold in length."""
    if int("".join(c for c in str(spark.conf.get(_BATCH_CONF)) if c.isdigit()) or 0) != size:
        spark.conf.set(_BATCH_CONF, str(size))


def build_session(app_name: str = "quirekit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A local session (tests) that names none gets a fresh temporary folder; a
    cluster session must name a shared one, since executors cannot read the
    driver's disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        # local-cluster runs its executors as other processes, so it needs a shared folder like any cluster
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="quirekit-checkpoint-")
    context.setCheckpointDir(named)
    return named
