"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of a text's 4-word shingles, repeats
included. Fingerprints that differ in at most ``RADIUS`` bits are linked; components come from the links.

Distances to reference fingerprints (pivots) do both steps of the search. The pivot ``base ^ bit`` is one nearer or one
farther than ``base`` depending on that bit alone, so the distances to a block's pivots, less the distance to ``base``,
are equal for two fingerprints just when they agree on that block. The bits are cut into ``BLOCKS`` blocks; fingerprints
that differ in at most four bits agree on two of six blocks at least, so each pair of blocks keys a table whose buckets
hold all partners. Within a bucket, rows are sorted by the distance to one pivot, pairs whose distance to any of
``PIVOTS`` pivots differs by more than the radius are discarded (the triangle inequality makes that safe), and the
survivors' bits are compared.

Only distinct fingerprints are searched, so exact copies cost one row. A bucket returns a star for each of its
components, never its pairs. A bucket of more than ``CHUNK`` rows is split into chunks whose pairs go to different
tasks. Components of the stars come from alternating large-star and small-star steps, each cut by a checkpoint.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; a text of fewer than four words is
one shingle; repeated rows share a component and each keeps its row; an empty table gives an empty result; components
are named by the least id, nulls apart (a component of nulls alone has a null id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import checkpointed, key_bitmap, seed_of, sifted, texts_of, unused
from quirekit.llm.wordhash import shingle_starts, slices, words_of

SHINGLE, SEED, RADIUS, BLOCKS, PIVOTS, CHUNK = 4, 42, 4, 6, 16, 4096
#: Edges a task of the search for components.
TASK_EDGES = 50_000
_WORK_BYTES = 1 << 20

_cuts = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
#: Bits of each block, and the pairs of blocks that key a table.
MASKS = [np.uint64(sum(1 << b for b in range(_cuts[i], _cuts[i + 1]))) for i in range(BLOCKS)]
TABLES = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
BASE = np.uint64(seed_of("pivot base"))
DENSE = np.array([seed_of(f"pivot {i}") for i in range(PIVOTS)], np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def fingerprints(column: pa.Array) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a column of texts without nulls."""
    words = words_of(column)
    at, begin = shingle_starts(words.first, SHINGLE)
    last = np.minimum(at + SHINGLE, np.repeat(words.first[1:], np.diff(begin))) - 1
    if not len(at):
        return np.zeros(len(column), np.uint64)
    # Words side by side with one space between them, so that a shingle is one run of bytes.
    lengths = words.ends - words.starts
    to = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=to[1:])
    joined = np.full(to[-1], 32, np.uint8)
    spread = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[np.repeat(to[:-1], lengths) + spread] = words.data[np.repeat(words.starts, lengths) + spread]
    view, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(to[at].tolist(), (to[last + 1] - 1).tolist())], np.uint64)
    return majority_bits(hashes, begin)


def majority_bits(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits set in over half of it; 0 for an empty run. Run i is ``begin[i]`` to ``begin[i + 1]``."""
    out, full = np.zeros(len(begin) - 1, np.uint64), np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    shingles = np.diff(begin)[full]
    # Two bits at a time: each half of a word counts one of them, so a single sum by text does for both.
    for low in range(32):
        sums = np.add.reduceat((hashes >> np.uint64(low)) & np.uint64(1 << 32 | 1), begin[full])
        for bit, count in ((low, sums & np.uint64(0xFFFFFFFF)), (low + 32, sums >> np.uint64(32))):
            out[full] |= (count.astype(np.int64) * 2 > shingles).astype(np.uint64) << np.uint64(bit)
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text) and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                yield pa.record_batch([batch.column(0), batch.column(1), _signed(fingerprints(batch.column(2)))], ["doc_id", "mark", "fp"])

    marked = docs.select(F.col("doc_id").cast("long"), mark_of("text").alias("mark"), "text")
    return texts_of(marked, "doc_id", "mark").mapInArrow(run, "doc_id long, mark long, fp long")


def mark_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def key_of(doc_id: str, mark: str) -> Column:
    """One long for an id (null allowed) and the hash of its text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(mark))


def block_values(fps: np.ndarray) -> list[np.ndarray]:
    """For each block the bits read off its pivots: nearer to ``base ^ bit`` than to ``base``, or farther."""
    from_base = distance(fps, BASE)
    out = []
    for low, high in zip(_cuts[:-1], _cuts[1:], strict=True):
        value = np.zeros(len(fps), np.int64)
        for bit in range(low, high):
            value |= (distance(fps, BASE ^ np.uint64(1 << bit)) < from_base).astype(np.int64) << (bit - low)
        out.append(value)
    return out


def table_rows(distinct: DataFrame) -> DataFrame:
    """A row ``(bucket, fp)`` for each fingerprint and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = block_values(fps)
            keys = [np.int64(t) << 48 | values[a] << 24 | values[b] for t, (a, b) in enumerate(TABLES)]
            yield pa.record_batch([pa.array(np.concatenate(keys)), _signed(np.tile(fps, len(keys)))], ["bucket", "fp"])

    return distinct.select("fp").mapInArrow(run, "bucket long, fp long")


def split_buckets(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(bucket, cell, fp)`` and further columns: buckets of one row go, large ones are cut into cells that hold two chunks each."""
    rest = [c for c in rows.columns if c != "bucket"]
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = rows.join(counts, "bucket").select("bucket", *rest, parts.alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other))
    return rows.select("bucket", F.explode(cells).alias("cell"), *rest)


def close_pairs(groups: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius and the same group; ``groups`` is sorted."""
    first = distance(fps, DENSE[0])
    order = np.lexsort((first, groups))
    groups, fps, first = groups[order], fps[order], first[order]
    at = np.arange(len(fps) - 1) if len(fps) > 1 else np.zeros(0, np.int64)
    left, right, step = [], [], 1
    while len(at):
        at = at[at + step < len(fps)]
        # Sorted by the first coordinate: once it is too far, every later row of the group is.
        at = at[(groups[at] == groups[at + step]) & (first[at + step] - first[at] <= RADIUS)]
        near, other = at, at + step
        for pivot in DENSE[1:]:
            if len(near) < 64:
                break
            kept = np.abs(distance(fps[near], pivot) - distance(fps[other], pivot)) <= RADIUS
            near, other = near[kept], other[kept]
        kept = distance(fps[near], fps[other]) <= RADIUS
        left.append(order[near[kept]])
        right.append(order[other[kept]])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def stars(n: int, left: np.ndarray, right: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For each of n rows the least fingerprint (signed) of its component under the given pairs."""
    label = fps.view(np.int64).copy()
    while len(left):
        least = np.minimum(label[left], label[right])
        moved = (label[left] != least) | (label[right] != least)
        if not moved.any():
            break
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
    return label


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows sorted by their first two columns, bucket and cell, none of them ending within a cell."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        # Rows of the last cell may go on in the next batch.
        bucket, cell = (table.column(i).to_numpy() for i in (0, 1))
        last = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        kept = table.slice(cut)
    if kept is not None:
        yield kept.combine_chunks()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_cells(batches):
        bucket, cell = (table.column(i).to_numpy() for i in (0, 1))
        fps = table.column(2).to_numpy().view(np.uint64)
        change = np.r_[False, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]
        left, right = close_pairs(np.cumsum(change), fps)
        label, own = stars(len(fps), left, right, fps), fps.view(np.int64)
        linked = label != own
        yield pa.record_batch([pa.array(own[linked]), pa.array(label[linked])], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Star edges ``(u, v)``, ``v < u``, that connect just what fingerprints within the radius connect."""
    cells = split_buckets(table_rows(distinct))
    found = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_search, "u long, v long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node with an edge, the root being the least node of its component.

    Large-star: each node links its larger neighbours to its least one. Small-star: each node links its smaller ones to
    their least. A round moves every node about half way to its root; only minima meet in a group, never neighbours.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    cores, rows, state = edges.sparkSession.sparkContext.defaultParallelism, edges.count(), None
    while True:
        # Few rows go in few tasks: each task of a shuffle leaves files of its own, which would take more disk than the rows.
        few = max(cores, -(-rows // TASK_EDGES))
        edges = edges.coalesce(few)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few)
        # Every u > v here, so a node's smaller neighbours are just its v.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").coalesce(few)
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpointed(small.distinct().coalesce(few))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select("u", F.col("v").alias("root"))
        rows, state = now[0], now


def named_components(prints: DataFrame) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    member = distinct.join(roots, distinct.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = checkpointed(fingerprint_documents(docs))
    named = named_components(prints)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, prints: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """One row of each component, with all columns: the least id's (nulls last), of equal ids the least text hash's.

    ``prints`` and ``named`` give other components than those of the fingerprints: ``doc_id, mark, fp`` and ``fp, root``.

    Rows are chosen by id and text hash, narrow columns only; the rows to drop, a minority in most corpora, are then taken
    out of the documents. Rows alike in id and text are one key; of a kept key one row stays.
    """
    if prints is None:
        prints = checkpointed(fingerprint_documents(docs))
    named = named_components(prints) if named is None else named
    keys = prints.groupBy("doc_id", "mark", "fp").agg(F.count("*").alias("n")).join(named.select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = keys.groupBy("root").agg(F.min(order).alias("first"))
    mark = unused("text_mark", docs)
    key_id, key_mark = unused("kept_id", docs), unused("kept_mark", docs)
    kept = checkpointed(keys.join(first, "root").select(
        F.col("doc_id").alias(key_id), F.col("mark").alias(key_mark), "n", (order == F.col("first")).alias("keep")))
    marked = docs.withColumn(mark, mark_of("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key_id)) & (F.col(mark) == F.col(key_mark))
    # A bitmap tells most rows to keep where they are read; only the others' texts are shuffled, for the exact join.
    gone, maybe = kept.where(~F.col("keep")).select(key_id, key_mark), unused("maybe_gone", docs)
    marked = sifted(marked, key_of("doc_id", mark), key_bitmap(gone, key_of(key_id, key_mark)), maybe)
    left = marked.where(~F.col(maybe)).unionByName(marked.where(maybe).join(gone, same, "left_anti"))
    repeated = kept.where(F.col("keep") & (F.col("n") > 1)).select(key_id, key_mark)
    if not repeated.isEmpty():
        alike = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", mark])
        left = left.join(repeated, same, "left_anti").unionByName(alike)
    return left.select(*docs.columns)
