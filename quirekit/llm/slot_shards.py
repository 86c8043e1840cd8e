"""Sharding by fixed virtual slots: records hash into thousands of slots, slots are mapped to shards.

A record's slot never changes. The map from slots to shards is a small versioned table: built from the bytes of each
slot (largest slot first, to the shard with the fewest bytes), stored with the data, and edited when shards are added:
``rebalance`` moves only as many slots as even bytes need, and only into shards that lack bytes.

Defined cases: a null text has no bytes (size 1); rows alike in every column of a record are told apart by a running
number, and each thousand of them has a slot of its own, so a row repeated without end does not fill one slot; an empty
table gives an empty result; a null ``doc_id`` hashes like a value.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Virtual slots, fixed for the life of a data set; repeats of one record that share a slot.
SLOTS, REPEATS = 4096, 1024
_MAP_SCHEMA = "version int, vslot int, shard int, bytes long, n_rows long"


def records(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, copy``: narrow rows; equal records are counted first and unfolded after."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    return counted.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The record's virtual slot, from nothing but the record."""
    key = F.xxhash64("doc_id", "size", "text_crc32", F.floor(F.col("copy") / REPEATS))
    return rows.withColumn("vslot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def build_map(spark: SparkSession, sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map. ``sizes`` has at most ``slots`` rows, so it is read by the driver."""
    known = {r.vslot: (r.bytes, r.n_rows) for r in sizes.collect()}
    heap = [(0, 0, s) for s in range(shards)]
    rows = []
    for slot in sorted(range(slots), key=lambda v: (-known.get(v, (0, 0))[0], v)):
        size, count = known.get(slot, (0, 0))
        filled, held, shard = heapq.heappop(heap)
        heapq.heappush(heap, (filled + size, held + 1, shard))
        rows.append((1, slot, shard, size, count))
    return spark.createDataFrame(rows, _MAP_SCHEMA)


def rebalance(spark: SparkSession, old: DataFrame, shards: int) -> DataFrame:
    """The next version for more shards: new shards take slots until they hold an even share; no other slot moves."""
    rows = [r.asDict() for r in old.collect()]
    bytes_of = {s: 0 for s in range(shards)}
    for r in rows:
        bytes_of[r["shard"]] += r["bytes"]
    before = {r["shard"] for r in rows}
    share = sum(bytes_of.values()) / shards
    for r in sorted(rows, key=lambda r: (-r["bytes"], r["vslot"])):
        giver, taker = r["shard"], min((s for s in range(shards) if s not in before), key=lambda s: (bytes_of[s], s), default=None)
        if taker is None or bytes_of[giver] - r["bytes"] < share - r["bytes"] / 2 or bytes_of[taker] + r["bytes"] > share + r["bytes"] / 2:
            continue
        bytes_of[giver] -= r["bytes"]
        bytes_of[taker] += r["bytes"]
        r["shard"] = taker
    version = max(r["version"] for r in rows) + 1
    return spark.createDataFrame([(version, r["vslot"], r["shard"], r["bytes"], r["n_rows"]) for r in rows], _MAP_SCHEMA)


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Append a version of the map to its table."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    stored = spark.read.schema(_MAP_SCHEMA).parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and place in the shard of each record: the rows of the shard's slots before it, then its rank in its slot.

    The map has a row a slot, a fixed number, so it is broadcast and its running totals are one small window.
    """
    before = F.sum("n_rows").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1))
    places = slot_map.select("vslot", "shard", "version", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    return (rows.withColumn("rank", rank).join(F.broadcast(places), "vslot")
            .withColumn("slot", (F.col("offset") + F.col("rank")).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard by even bytes (law ``bytes``)."""
    rows = with_slots(records(docs), slots)
    slot_map = build_map(docs.sparkSession, slot_sizes(rows), shards, slots)
    return assign(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
