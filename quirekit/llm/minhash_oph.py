"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once. The high bits choose one of ``BINS`` bins, the rest is the value of which a bin keeps the
least. An empty bin takes the value of the first full bin in its own hashed order of bins (optimal densification), so
equal bins of two texts agree with a chance equal to their Jaccard similarity. Of each value the low ``BITS`` bits are
packed, and the estimate subtracts the agreement that chance gives: ``(agreeing - 2^-BITS) / (1 - 2^-BITS)``.

Defined cases: a null text is empty; an empty text (no words) has the fingerprint ``""``, likeness 1 to another empty
one and 0 to the rest; equal texts have equal fingerprints; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import range_bounds, range_bucket, shuffle_partitions, texts_of
from quirekit.llm.wordhash import mix, seed_of, shingle_hashes, slices, words_of

#: Words a shingle, bins a fingerprint (a power of two), bits kept of each bin (4: two bins a byte).
SHINGLE, BINS, BITS = 5, 512, 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_WORK_BYTES = 1 << 20


def _sequences() -> np.ndarray:
    """Each bin's fixed order of all bins, drawn by hashing (bin, candidate)."""
    bins = np.arange(BINS, dtype=np.uint64)
    keys = mix(bins[:, None] * np.uint64(seed_of("densify bin")) + bins[None, :] * np.uint64(seed_of("densify candidate")))
    return np.argsort(keys, axis=1)


_ORDER = _sequences()
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)


#: Added to a bin's value before its low bits are taken, so that one value in many bins is not one draw of chance.
_OWN_BITS = np.arange(BINS, dtype=np.uint64) * np.uint64(seed_of("low bits"))


def densify(table: np.ndarray) -> np.ndarray:
    """Give each empty bin the value of the first full bin in its own order; rows without a full bin stay empty."""
    full = table != _NONE
    held = full.sum(axis=1)
    out = table.copy()
    for row in np.flatnonzero((held > 0) & (held <= 24)):
        some = np.flatnonzero(full[row])
        nearest = some[_RANK[:, some].argmin(axis=1)]
        out[row] = np.where(full[row], table[row], table[row, nearest])
    rows, bins = np.nonzero(~full & (held > 24)[:, None])
    for turn in range(BINS):
        if not len(rows):
            break
        found = table[rows, _ORDER[bins, turn]]
        done = found != _NONE
        out[rows[done], bins[done]] = found[done]
        rows, bins = rows[~done], bins[~done]
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """``n x BINS/2`` bytes of packed low-order bits; texts without words have zero rows and are told by ``has_words``."""
    words = words_of(column)
    hashes, begin = shingle_hashes(words, SHINGLE)
    table = np.full((len(column), BINS), _NONE, np.uint64)
    row = np.repeat(np.arange(len(column)), np.diff(begin))
    place = row * BINS + (hashes >> _SHIFT).astype(np.int64)
    np.minimum.at(table.reshape(-1), place, hashes & ((np.uint64(1) << _SHIFT) - np.uint64(1)))
    low = (mix(densify(table) + _OWN_BITS) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[np.diff(begin) == 0] = 0
    return low[:, 0::2] << 4 | low[:, 1::2]


def likeness(a: str, b: str) -> float:
    """Bias-corrected Jaccard estimate of two fingerprints, from 0 to 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)
    agree = (np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return max(0.0, (agree - chance) / (1 - chance))


def printed(texts: list[str]) -> list[str]:
    """Fingerprints as hexadecimal strings, ``""`` for texts without words."""
    column = pa.array(texts, pa.large_string())
    out = []
    for batch in slices(pa.record_batch([column], ["text"]), "text", _WORK_BYTES):
        known = np.diff(words_of(batch.column(0)).first) > 0
        out += [row.tobytes().hex() if ok else "" for row, ok in zip(fingerprints(batch.column(0)), known, strict=True)]
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = printed(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    frame = texts_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    return frame.mapInArrow(run, f"id {kind.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last third (code points, rounded down) replaced by the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likeness and that to the next document's.

    The next document is the one before in ascending ``doc_id`` (ties: by text); after the smallest comes the largest.
    Rows are cut into ranges of ``doc_id``; each range also gets the last row of the range below it, so a text moves
    once, no range waits for another, and only one row a range is sent twice. A null ``doc_id`` sorts first.
    """
    spark = docs.sparkSession
    frame = texts_of(docs, "doc_id")
    width = shuffle_partitions(spark)
    bounds = range_bounds(docs.select("doc_id"), "doc_id", 4 * width)
    ranged = frame.withColumn("range", range_bucket(F.col("doc_id"), bounds))
    # One id a range: the last. Its row (of several with that id the last by text) leads the next range that has rows.
    lasts = sorted((r["range"], r.last) for r in
                   docs.select("doc_id", range_bucket(F.col("doc_id"), bounds).alias("range"))
                   .groupBy("range").agg(F.max("doc_id").alias("last")).collect())
    lead_schema = f"last {docs.schema['doc_id'].dataType.simpleString()}, lead int"
    leads = [(last, lasts[(i + 1) % len(lasts)][0]) for i, (_, last) in enumerate(lasts)]
    lead = (ranged.join(F.broadcast(spark.createDataFrame(leads, lead_schema)), F.col("doc_id").eqNullSafe(F.col("last")))
            .groupBy("lead").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc_id")))
    rows = ranged.withColumn("own", F.lit(True)).unionByName(
        lead.select("doc_id", "text", F.col("lead").alias("range"), F.lit(False).alias("own")))
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    ordered = rows.repartition(4 * width, "range").sortWithinPartitions("range", "own", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.select("range", "own", "doc_id", "text").mapInArrow(_compare, schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_text, last_print = "", ""
    for whole in batches:
        for batch in slices(whole, "text", _WORK_BYTES):
            own, ids, texts = batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            prints = printed(texts)
            before = [last_text, *texts[:-1]]
            before_prints = [last_print, *prints[:-1]]
            changed = [edited(t, b) for t, b in zip(texts, before, strict=True)]
            changed_prints = printed(changed)
            keep = [i for i, mine in enumerate(own) if mine]
            yield pa.record_batch(
                [
                    ids.take(pa.array(keep, pa.int64())).cast(pa.int64()),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in keep], pa.string()),
                    pa.array([prints[i] for i in keep], pa.string()),
                    pa.array([changed_prints[i] for i in keep], pa.string()),
                    pa.array([likeness(prints[i], changed_prints[i]) for i in keep], pa.float64()),
                    pa.array([likeness(prints[i], before_prints[i]) for i in keep], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            last_text, last_print = texts[-1], prints[-1]
