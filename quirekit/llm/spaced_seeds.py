"""Benchmark decontamination with spaced seeds.

A seed looks at some tokens of a window and ignores the rest, by a fixed mask; a passage with a token swapped still hits
wherever the swap falls on an ignored place. The hashes of all windows of the benchmark items are joined with those of
all windows of the training texts; around each hit the item is laid on the text at that offset, and the best stretch is
kept if it is long enough and at least ``IDENTITY`` of its tokens are equal.

Training windows are first tried against a bitmap of the benchmark's hashes, of a fixed size whatever the benchmark, so
nearly only real hits leave the scan; the join decides. A hit travels with the tokens around it, never with its text.

The masks miss nothing that the rule asks for: of all ways to swap a fifth of the tokens of a stretch of 13 to 20, or of an
item of 8 to 12, none lacks a hit (``tests`` go through all of them; a longer stretch holds such a one).

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, A-Z as a-z. Defined cases: null and empty texts
have no tokens; a text or item shorter than a mask is tried by windows of the item's whole length; items of fewer than
``LEAST`` tokens match nothing, since ordinary prose holds them; repeated rows count once for each id; empty tables
give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import checkpointed, seed_of, texts_of, unused
from quirekit.llm.wordhash import Words, mix, slices, words_of

#: Masks: 1 is looked at, 0 ignored.
MASKS = ("11101001", "11010011", "10110101", "110111")
SPAN = 8
#: Masks for items too short for a stretch of ``STRETCH`` tokens, of which the whole must be there.
SHORT_MASKS = ("100111", "1001011")
#: Tokens a shared stretch must have (a shorter item: all of its tokens), and the least share of equal ones.
STRETCH, IDENTITY, LEAST = 13, 0.8, 5
_BITS = 1 << 26
_WORK_BYTES = 1 << 20
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def masks_for(length: int) -> list[str]:
    """Masks for an item of that many tokens: the spaced ones, or all of its tokens if it has fewer than ``SPAN``."""
    if length >= SPAN:
        return list(MASKS) if length >= STRETCH else list(SHORT_MASKS)
    return ["1" * length] if length >= LEAST else []


def window_hashes(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First token of every window inside one text, and the hash of the tokens that the mask looks at."""
    span = len(mask)
    count = np.maximum(np.diff(words.first) - span + 1, 0)
    begin = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(begin - words.first[:-1], count)
    total = np.full(len(at), seed_of(f"mask {mask}"), np.uint64)
    for j, looked in enumerate(mask):
        if looked == "1":
            total += words.hashes[at + j] * np.uint64(seed_of(f"place {j}"))
    return at, mix(total)


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(_BITS - 1)


def _tokens(column: pa.Array) -> Words:
    return words_of(column, blank=SEPARATOR)


def benchmark_tokens(items: DataFrame) -> DataFrame:
    """``item_id, tokens``: 64-bit token hashes of each item that can match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _tokens(batch.column(1))
            lists = [words.hashes[a:b].view(np.int64) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "tokens"])

    return texts_of(items, "item_id").mapInArrow(run, "item_id long, tokens array<long>").where(F.size("tokens") >= LEAST)


def benchmark_seeds(tokens: DataFrame) -> DataFrame:
    """``hash, item_id, at``: every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = row.values.to_numpy().view(np.uint64)
                words = Words(hashes, hashes, hashes, hashes, np.array([0, len(hashes)]))
                for mask in masks_for(len(hashes)):
                    at, found = window_hashes(words, mask)
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.full(len(at), item, np.int64)), pa.array(at.astype(np.int32))],
                                          ["hash", "item_id", "at"])

    return tokens.mapInArrow(run, "hash long, item_id long, at int")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Two bits a hash in a bitmap of 8 MB; its words are merged by Spark, one row a word at most."""
    low, high = F.col("hash").bitwiseAND(_BITS - 1), F.shiftright("hash", 32).bitwiseAND(_BITS - 1)
    bits = seeds.select(F.explode(F.array(low, high)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("v"))
    out = np.zeros(_BITS // 32, np.uint32)
    for row in words.collect():
        out[row.w] = row.v
    return out


def _regions(words: Words, at: np.ndarray, hashes: np.ndarray, around: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Hits of a text that lie within ``around`` tokens of each other, as ``(text, low, high, indexes)``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    text = np.searchsorted(words.first, at, "right") - 1
    breaks = np.flatnonzero((np.diff(text) != 0) | (np.diff(at) > around)) + 1
    for some in np.split(np.arange(len(at)), breaks):
        if len(some):
            t = int(text[some[0]])
            low = max(int(words.first[t]), int(at[some[0]]) - around)
            high = min(int(words.first[t + 1]), int(at[some[-1]]) + around)
            yield t, low, high, order[some]


def candidate_regions(docs: DataFrame, bitmap, longest: int, short: list[int]) -> DataFrame:
    """``doc_id, base, tokens, hits``: stretches of texts around windows that the bitmap knows.

    ``longest`` is the token count of the longest item, ``short`` the lengths of items below ``STRETCH`` tokens.
    """
    masks = [*MASKS, *dict.fromkeys(m for n in short for m in masks_for(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        test = lambda bit: known[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                words = _tokens(batch.column(1))
                places, found = [], []
                for mask in masks:
                    at, hashes = window_hashes(words, mask)
                    low, high = _probes(hashes)
                    hit = np.flatnonzero(test(low))
                    hit = hit[test(high[hit]) == 1]
                    places.append(at[hit])
                    found.append(hashes[hit])
                at, hashes = np.concatenate(places), np.concatenate(found)
                rows = list(_regions(words, at, hashes, longest + SPAN))
                if rows:
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array([r[0] for r in rows])).cast(pa.int64()),
                         pa.array([low - int(words.first[t]) for t, low, _, _ in rows], pa.int64()),
                         pa.array([words.hashes[low:high].view(np.int64) for _, low, high, _ in rows], pa.list_(pa.int64())),
                         pa.array([(at[i] - low).astype(np.int32) for _, low, _, i in rows], pa.list_(pa.int32())),
                         pa.array([hashes[i].view(np.int64) for *_, i in rows], pa.list_(pa.int64()))],
                        ["doc_id", "base", "tokens", "places", "hashes"])

    schema = "doc_id long, base long, tokens array<long>, places array<int>, hashes array<long>"
    return texts_of(docs, "doc_id").mapInArrow(run, schema)


def best_stretch(text: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int] | None:
    """``(first token in the text, tokens, equal tokens)`` of the longest shared stretch with the item at ``offset``.

    The longest of all stretches that begin and end on equal tokens and have a share of ``IDENTITY`` or more; it must have
    ``STRETCH`` tokens, or be the whole of an item that has no more (all equal if it has fewer than ``SPAN``).
    """
    low, high = max(0, offset), min(len(text), offset + len(item))
    if high <= low:
        return None
    same = text[low:high] == item[low - offset : high - offset]
    if len(item) <= STRETCH:
        equal, least = int(same.sum()), len(item) if len(item) < SPAN else IDENTITY * len(item) - 1e-9
        return (low, high - low, equal) if high - low == len(item) and equal >= least else None
    # Running totals do not fall over a stretch that has its share of equal places. From each equal place, the farthest
    # equal place up to which that holds: later maxima never rise from left to right.
    totals = np.r_[0, np.cumsum(np.where(same, 1000, 0) - round(1000 * IDENTITY))]
    later = np.maximum.accumulate(np.where(same, totals[1:], -(1 << 60))[::-1])[::-1]
    starts = np.flatnonzero(same)
    if not len(starts):
        return None
    sizes = np.searchsorted(-later, -totals[starts], "right") - starts
    best = int(np.argmax(sizes))
    start, size = int(starts[best]), int(sizes[best])
    return (low + start, size, int(same[start : start + size].sum())) if size >= STRETCH else None


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, n_tokens, n_equal``: the best shared stretch of each document and item that share one."""
    spark = docs.sparkSession
    tokens = checkpointed(benchmark_tokens(items))
    lengths = tokens.select(F.size("tokens").alias("n"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    short = sorted(r.n for r in lengths.where(F.col("n") < STRETCH).distinct().collect())
    seeds = checkpointed(benchmark_seeds(tokens))
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    regions = checkpointed(candidate_regions(docs, bitmap, longest, short).withColumn("region", F.xxhash64("doc_id", "base", "tokens")))
    hits = regions.select("region", F.explode(F.arrays_zip("places", "hashes")).alias("hit")).select("region", F.col("hit.places").alias("place"), F.col("hit.hashes").alias("hash"))
    laid = hits.join(seeds, "hash").select("region", "item_id", (F.col("place") - F.col("at")).alias("offset")).distinct()
    item_tokens = tokens.select("item_id", F.col("tokens").alias("item"))
    pairs = laid.join(regions.select("region", "doc_id", "base", "tokens"), "region").join(item_tokens, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, item = (batch.column(n)[i].values.to_numpy() for n in ("tokens", "item"))
                got = best_stretch(text, item, batch.column("offset")[i].as_py())
                if got:
                    rows.append((batch.column("doc_id")[i].as_py(), batch.column("item_id")[i].as_py(), batch.column("base")[i].as_py() + got[0], *got[1:]))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "n_tokens", "n_equal"])

    found = pairs.select("doc_id", "base", "tokens", "item_id", "item", "offset").mapInArrow(
        verify, "doc_id long, item_id long, start long, n_tokens long, n_equal long")
    best = F.max_by(F.struct("start", "n_tokens", "n_equal"), F.struct("n_equal", -F.col("start"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.start", "best.n_tokens", "best.n_equal")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that share no stretch with any item; rows without an id are judged by their text alone."""
    # A key of id and text, so that one contaminated row does not take others with its id along.
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    own = unused("row_key", docs)
    keyed = docs.withColumn(own, key)
    dirty = overlaps(keyed.select(F.col(own).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(own)).distinct()
    return keyed.join(dirty, own, "left_anti").drop(own)
