"""Near-duplicate documents by the general rule: at least 0.8 of their 5-word shingles shared.

Two texts are linked if the Jaccard similarity of their sets of word shingles is ``SIMILAR`` or more; components come
from the links. Every link is verified on the whole shingle sets; nothing is linked by an estimate.

The SimHash search comes first: a fingerprint of each shingle set, the pivot tables of ``simhash_pivots`` over the
fingerprints, and groups of sets whose fingerprints hang together. A set is compared with the others of its cell and
with the least set of its group, which is in every cell, so a group costs a row a set however large it is.

Fingerprints within the radius are the closest pairs only: at a similarity of 0.8 about 15 % of a SimHash's bits differ,
whatever its width, which is too many for keys made of bits. The pairs that are left are found by least hash values:
``BANDS`` bands of ``WIDTH`` values each key a bucket, so that a pair at 0.8 is missed by all bands with a chance of
1.5e-5 and a closer one more rarely. Only buckets count that still hold several components: those the SimHash search has
made one are not compared again, and the first ``EARLY`` bands are searched before the others. Large buckets are cut into
cells as in ``simhash_pivots``.

Equal shingle sets are one row of the search, buckets with the same rows are searched once, and a bucket returns a star
for each of its components.

Defined cases: texts without words (null, empty, blank) are alike; a text of fewer than five words is one shingle; else
as in ``simhash_pivots``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm import simhash_pivots
from quirekit.llm.common import checkpointed, key_bitmap, seed_of, sifted, texts_of
from quirekit.llm.simhash_pivots import components, key_of, links, majority_bits, mark_of, split_buckets, whole_cells
from quirekit.llm.wordhash import mix, shingle_hashes, slices, words_of

#: Words a shingle; least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
BANDS, WIDTH, EARLY, CHUNK = 28, 5, 4, 1024
_WORK_BYTES = 1 << 20
_SEEDS = np.array([seed_of(f"least hash {i}") for i in range(BANDS * WIDTH)], np.uint64)
_PLACES = np.array([seed_of(f"band place {i}") for i in range(WIDTH)], np.uint64)
_OWN = np.array([seed_of(f"band {i}") for i in range(BANDS)], np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and the n + 1 places where each text's begin."""
    hashes, begin = shingle_hashes(words_of(column), SHINGLE)
    row = np.repeat(np.arange(len(column)), np.diff(begin))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    first = np.zeros(len(column) + 1, np.int64)
    np.cumsum(np.bincount(row[fresh], minlength=len(column)), out=first[1:])
    return hashes[fresh], first


def set_prints(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A signed hash of each set; 0 for an empty one."""
    out, full = np.zeros(len(first) - 1, np.uint64), np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(values), first[full]) + np.diff(first)[full].astype(np.uint64))
    return out.view(np.int64)


def band_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` signed keys for each set that is not empty."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(full), BANDS), np.uint64)
    if len(full):
        for i, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat((values ^ seed) * seed, first[full])
            out[:, i // WIDTH] += mix(least) * _PLACES[i % WIDTH]
    return mix(out + _OWN).view(np.int64)


def print_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``fp`` (a hash of its shingle set), the set's ``simhash``, and ``bands``, empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                values, first = shingle_sets(batch.column(2))
                keys = pa.array(band_keys(values, first).reshape(-1))
                ends = np.r_[0, np.cumsum((np.diff(first) > 0) * BANDS)].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), keys)
                simhash = pa.array(majority_bits(values, first).view(np.int64))
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(set_prints(values, first)), simhash, bands], ["doc_id", "mark", "fp", "simhash", "bands"])

    marked = docs.select(F.col("doc_id").cast("long"), mark_of("text").alias("mark"), "text")
    return texts_of(marked, "doc_id", "mark").mapInArrow(run, "doc_id long, mark long, fp long, simhash long, bands array<long>")


def simhash_cells(distinct: DataFrame) -> DataFrame:
    """``(bucket, cell, fp)`` of the groups of several sets whose fingerprints hang together; a group's least set is in each of its cells."""
    sets = distinct.where(F.size("bands") > 0).select("fp", "simhash")
    roots = components(links(sets.select(F.col("simhash").alias("fp")).distinct()))
    rows = sets.join(roots, sets.simhash == roots.u, "left").select(F.coalesce("root", "simhash").alias("bucket"), "fp")
    groups = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    cells = F.when(F.col("fp") == F.col("least"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), parts).cast("int")))
    return rows.join(groups, "bucket").select("bucket", F.explode(cells).alias("cell"), "fp")


def shared_buckets(distinct: DataFrame) -> DataFrame:
    """``(bucket, band, fp)`` of the buckets of several rows; of buckets with the same rows the one of the least band."""
    rows = distinct.select("fp", F.posexplode("bands").alias("band", "bucket"))
    members = [F.bit_xor(F.xxhash64("fp", F.lit(i))) for i in range(2)]
    counts = rows.groupBy("bucket", "band").agg(F.count("*").alias("n"), members[0].alias("a"), members[1].alias("b")).where("n > 1")
    once = counts.groupBy("n", "a", "b").agg(F.min(F.struct("band", "bucket")).alias("at")).select("at.band", "at.bucket")
    return rows.join(once, ["bucket", "band"]).select("bucket", "band", "fp")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp, shingles`` (64-bit hashes in order) of the wanted ``doc_id, mark``, and of few others.

    Texts are not shuffled: a bitmap of the wanted keys chooses them where they are read, and sets chosen by chance find no
    partner in the joins that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                values, first = shingle_sets(batch.column(0))
                cells = pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.record_batch([pa.array(set_prints(values, first)), cells], ["fp", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), "text", mark_of("text").alias("mark"))
    chosen = sifted(texts, key_of("doc_id", "mark"), key_bitmap(wanted, key_of("doc_id", "mark")), "chosen").where("chosen")
    return texts_of(chosen).mapInArrow(run, "fp long, shingles binary").dropDuplicates(["fp"])


def joined(values: np.ndarray, first: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The parts of a bucket's rows, those of rows that are similar made one."""
    ids = np.unique(values, return_inverse=True)[1]
    size, part, mark = np.diff(first), part.copy(), np.zeros(len(values), np.int64)
    over, under = SIMILAR
    for i in range(len(size) - 1):
        # Rows already in one part need no comparison; the sizes alone rule out others.
        rest = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        rest = rest[np.minimum(size[rest], size[i]) * under >= over * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        own = ids[first[i] : first[i + 1]]
        mark[own] = 1
        begin = np.cumsum(size[rest]) - size[rest]
        at = np.arange(int(size[rest].sum())) + np.repeat(first[rest] - begin, size[rest])
        shared = np.add.reduceat(mark[ids[at]], begin)
        mark[own] = 0
        near = rest[shared * under >= over * (size[rest] + size[i] - shared)]
        if len(near):
            part[np.isin(part, part[near])] = part[i]
    return part


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_cells(batches):
        bucket, cell, fps, root = (table.column(i).to_numpy() for i in range(4))
        sets = [np.frombuffer(x, np.uint64) for x in table.column(4).to_pylist()]
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
        label = fps.copy()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
            if b - a < 2:
                continue
            first = np.r_[0, np.cumsum([len(s) for s in sets[a:b]])]
            part = joined(np.concatenate(sets[a:b]), first, np.unique(root[a:b], return_inverse=True)[1])
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, part, fps[a:b])
            label[a:b] = least[part]
        linked = label != fps
        yield pa.record_batch([pa.array(fps[linked]), pa.array(label[linked])], ["u", "v"])


def found_in(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Star edges ``(u, v)`` between the similar sets of each cell of ``bucket, cell, fp, root``."""
    whole = cells.join(sets, "fp").select("bucket", "cell", "fp", "root", "shingles")
    return whole.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_search, "u long, v long").distinct()


def named_components(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``fp, root`` of every distinct shingle set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    distinct = checkpointed(prints.groupBy("fp").agg(first, F.first("simhash").alias("simhash"), F.first("bands").alias("bands")))
    groups = checkpointed(simhash_cells(distinct))
    buckets = checkpointed(shared_buckets(distinct))
    wanted = distinct.join(groups.select("fp").union(buckets.select("fp")).distinct(), "fp", "left_semi").select("first.doc_id", "first.mark")
    sets = checkpointed(sets_of(docs, wanted))
    edges = checkpointed(found_in(groups.withColumn("root", F.col("fp")), sets))
    # Only a group's least set is in several cells, and no star links it to a lesser one: these stars are components.
    roots = edges.select("u", F.col("v").alias("root"))
    for low, high in ((0, EARLY), (EARLY, BANDS)):
        part = buckets.where((F.col("band") >= low) & (F.col("band") < high)).join(roots, buckets.fp == roots.u, "left")
        part = part.select("bucket", "fp", F.coalesce("root", "fp").alias("root"))
        open_ = part.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z")
        cells = split_buckets(part.join(open_.select("bucket"), "bucket", "left_semi"), CHUNK)
        edges = checkpointed(edges.union(found_in(cells, sets)))
        roots = components(edges)
    return distinct.join(roots, distinct.fp == roots.u, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns, chosen as by ``simhash_pivots.one_of_each``."""
    prints = checkpointed(print_documents(docs))
    return simhash_pivots.one_of_each(docs, prints, named_components(docs, prints))
