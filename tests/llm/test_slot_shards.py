from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from quirekit.llm import slot_shards as shards


def check(got, rows, n_shards):
    facts = sorted(str((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == facts
    places, filled, by_slot = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        places[r.shard].append(r.slot)
        filled[r.shard] += r["size"]
        by_slot[r.vslot].add(r.shard)
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))
    assert all(len(s) == 1 for s in by_slot.values()) and set(places) <= set(range(n_shards))
    return filled


def test_stored_rows(table):
    docs, rows = table("documents")
    got = shards.shard_documents(docs).collect()
    filled = check(got, rows, 8)
    most = max(len((r.text or "").encode()) + 1 for r in rows)
    assert len(filled) == 8 and max(filled.values()) - min(filled.values()) <= most


def test_odd_rows(spark, docs, no_docs):
    check(shards.shard_documents(docs).collect(), docs.collect(), 8)
    assert shards.shard_documents(no_docs).count() == 0


def test_one_row_repeated_without_end_is_spread(spark):
    docs = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = shards.shard_documents(docs).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in got) == 40_000 and len(got) == 8 and all(r.last == r.n - 1 for r in got)
    assert max(r.n for r in got) <= 2 * shards.REPEATS + 40_000 / 8


def test_versions_move_slots_only_into_new_shards(spark, table, tmp_path):
    docs, _ = table("documents")
    rows = shards.with_slots(shards.records(docs))
    folder = str(tmp_path / "map")
    first = shards.build_map(spark, shards.slot_sizes(rows), 8)
    shards.store_map(first, folder)
    shards.store_map(shards.rebalance(spark, shards.load_map(spark, folder), 9), folder)
    old = {r.vslot: r for r in shards.load_map(spark, folder, 1).collect()}
    new = {r.vslot: r for r in shards.load_map(spark, folder).collect()}
    assert {r.version for r in new.values()} == {2} and set(old) == set(new) == set(range(shards.SLOTS))
    assert all(new[v].shard in (old[v].shard, 8) for v in new)
    total, most = sum(r.bytes for r in old.values()), max(r.bytes for r in old.values())
    held = defaultdict(int)
    for r in new.values():
        held[r.shard] += r.bytes
    assert abs(held[8] - total / 9) <= 2 * most and max(held.values()) <= total / 8 + most
    check(shards.assign(rows, shards.load_map(spark, folder)).collect(), docs.collect(), 9)
