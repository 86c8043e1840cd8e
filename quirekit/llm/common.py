"""Shared pieces: bounded Arrow batches, checkpoints, range buckets over an ordering column."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.session import bounded_batches, ensure_checkpoint_dir


#: Words of 64 bits of a bitmap of keys.
BITMAP_WORDS = 1 << 19


def texts_of(frame: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text, a null text being empty."""
    bounded_batches(frame.sparkSession)
    return frame.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the frame as Parquet into a fresh place of the shared folder and read it back: smaller than a checkpoint."""
    path = f"{ensure_checkpoint_dir(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.options(compression="zstd", **options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def key_bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """``word, bits``: which places the hashed keys (longs) take. ``BITMAP_WORDS`` rows at most, so it can be broadcast whatever the keys."""
    place = F.pmod(key, F.lit(64 * BITMAP_WORDS))
    places = keys.select(F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit"))
    return places.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def sifted(frame: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """The frame and whether the bitmap may hold the row's key: never false for a key it holds, seldom true for another. Wide rows stay where they are."""
    word, bits = unused(f"{name}_word", frame), unused(f"{name}_bits", frame)
    place = F.pmod(key, F.lit(64 * BITMAP_WORDS))
    known = F.broadcast(bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    frame = frame.join(known, F.shiftright(place, 6) == F.col(word), "left")
    hit = F.call_function("shiftright", F.col(bits), (place % 64).cast("int")).bitwiseAND(1) == 1
    return frame.withColumn(name, F.coalesce(hit, F.lit(False))).drop(word, bits)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(frame: DataFrame, key: str, buckets: int) -> list:
    """At most ``buckets - 1`` increasing key values that cut the rows into even ranges."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = frame.select(F.percentile_approx(key, shares, 20_000).alias("b")).first()
    return sorted(set(row.b or []))


def range_bucket(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key (null key: 0), as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def seed_of(name: str) -> int:
    """A fixed odd 64-bit number for a name."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") | 1


def unused(name: str, frame: DataFrame) -> str:
    """The name, lengthened until no column has it (column names ignore case)."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name
