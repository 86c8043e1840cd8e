"""Ranked lexical search, accumulator-limited and term at a time.

Each item is a query against all documents. A task holds the postings of a run of documents and goes through an item's
terms rarest first. While the bounds of the terms ahead could still lift a new document to the kth score, each posting
may open an accumulator; once they cannot, no more are opened, accumulators that cannot reach it are given up, and the
rest are updated exactly. A term's bound is its weight times its largest impact in the run, and the kth score starts from
what the task has found in its earlier runs, so later runs open few accumulators. Every document that can be among an
item's best is scored in full, so the result is exact.

Postings are made for the items' terms only, from whole texts, and stored in the shared folder; a pass over them counts
documents and terms. Work is parted by documents: a term that every document holds costs each task its own share. Tasks
give out at most ``k`` rows an item, merged in two steps. Items are searched in blocks of ``BLOCK_ITEMS`` rows or
``BLOCK_CHARS`` characters, so what a task holds of them is bounded whatever their number.

Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z as a-z, compared by 64-bit hashes (a million
item terms against a billion different words meet by chance once in 20,000 corpora).

Defined cases: null and empty texts have no terms and are never found; an item without terms, or with none that a document
holds, has no rows; repeated document rows are ranked each, repeated item rows are each a query; among equal scores a null
``doc_id`` comes last; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirekit.llm.common import stored, texts_of
from quirekit.llm.wordhash import slices, words_of

BEST = 20
BLOCK_ITEMS, BLOCK_CHARS = 4096, 4 << 20
#: Documents whose postings are searched together, and groups of tasks whose rows are merged first.
RUN_DOCUMENTS, MERGES = 1 << 14, 64
_WORK_BYTES = 1 << 21
_NO_ID = np.iinfo(np.int64).max
#: Bytes outside terms: ASCII other than letters and digits.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

POSTINGS = "doc_ids array<long>, sizes array<long>, counts array<int>, terms binary, tfs binary"


@dataclass
class Queries:
    """A block of items: their ids, all their terms (sorted hashes), and each item's term numbers with repeats counted."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def queries_of(rows: list) -> Queries:
    """From ``(item_id, text)`` rows."""
    words = words_of(pa.array([r[1] or "" for r in rows], pa.string()), blank=OUTSIDE)
    hashes, number = np.unique(words.hashes, return_inverse=True)
    terms, repeats = [], []
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        some, times = np.unique(number.ravel()[low:high], return_counts=True)
        terms.append(some)
        repeats.append(times)
    return Queries([r[0] for r in rows], hashes, terms, repeats)


def blocks_of(items: DataFrame, most: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The item rows in bounded lists."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if held and (len(held) >= most or size + len(row.text or "") > chars):
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text or "")
    if held:
        yield held


def _small(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def make_postings(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """For each run of documents with terms: ids, term counts, and by document the numbers and counts of the items' terms."""
    spread = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = spread.value
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                words = words_of(batch.column(1), blank=OUTSIDE)
                sizes = np.diff(words.first)
                held = np.flatnonzero(sizes)
                if not len(held):
                    continue
                at = np.searchsorted(wanted, words.hashes)
                found = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == words.hashes) if len(wanted) else at[:0]
                owner = np.searchsorted(words.first, found, "right") - 1
                keys, tfs = np.unique(owner * max(len(wanted), 1) + at[found], return_counts=True)
                owner, terms = np.divmod(keys, max(len(wanted), 1))
                counts = np.bincount(owner, minlength=len(sizes))[held]
                yield pa.record_batch(
                    [pa.array([batch.column(0).take(pa.array(held)).to_pylist()], pa.list_(pa.int64())), pa.array([sizes[held]], pa.list_(pa.int64())),
                     pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([_small(terms)], pa.binary()), pa.array([_small(tfs)], pa.binary())],
                    ["doc_ids", "sizes", "counts", "terms", "tfs"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts_of(named, "doc_id").mapInArrow(run, POSTINGS)


def document_counts(postings: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the items' terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(terms, np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                vector += np.bincount(_large(held), minlength=terms)
        some = np.flatnonzero(vector)
        yield pa.record_batch([pa.array(some), pa.array(vector[some])], ["term", "n"])

    out = np.zeros(terms, np.int64)
    # As many rows as the block of items has terms.
    for row in postings.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def weights_of(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)


def length_norms(sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``100 - 25 + (25 * n * N) div L``."""
    if len(sizes) and 25 * int(sizes.max()) * documents < 1 << 63:
        return 75 + 25 * sizes * documents // total
    return np.array([75 + 25 * n * documents // total for n in sizes.tolist()], np.int64)


class Run:
    """Postings of some documents by term, with each posting's impact."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, total: int) -> None:
        norms = length_norms(sizes, documents, total)
        docs = np.repeat(np.arange(len(sizes)), counts)
        order = np.argsort(terms, kind="stable")
        self.size, self.docs, tfs = len(sizes), docs[order], tfs[order]
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * norms[self.docs])
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.stops = np.r_[self.starts[1:], len(terms)]
        self.largest = np.maximum.reduceat(self.impacts, self.starts) if len(terms) else self.impacts

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the run, with their scores, that can be among the best ``k``; ``weights`` fall along ``terms``.

        ``least`` is a score that ``k`` documents elsewhere reach; documents below it are of no use.
        """
        at = np.searchsorted(self.terms, terms)
        here = self.terms[np.minimum(at, len(self.terms) - 1)] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        bounds = weights * self.largest[at]
        ahead = np.r_[np.cumsum(bounds[::-1])[::-1], 0]
        scores, open_ = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        step, kth = 0, least
        while step < len(at) and ahead[step] >= kth:
            low, high = self.starts[at[step]], self.stops[at[step]]
            docs = self.docs[low:high]
            scores[docs] += weights[step] * self.impacts[low:high]
            open_[docs] = True
            step += 1
            partial = scores[open_]
            if len(partial) >= k:
                kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
        alive = np.flatnonzero(open_)
        scores = scores[alive]
        for step in range(step, len(at)):
            # What cannot reach the kth score any more is given up; the others go on exactly.
            able = scores + ahead[step] >= kth
            alive, scores = alive[able], scores[able]
            if not len(alive):
                break
            low, high = self.starts[at[step]], self.stops[at[step]]
            docs = self.docs[low:high]
            place = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            hit = docs[place] == alive
            scores[hit] += weights[step] * self.impacts[low + place[hit]]
            if len(scores) >= k:
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        able = (scores >= kth) & (scores > 0)
        return alive[able], scores[able]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def best_of_tasks(postings: DataFrame, queries: Queries, weights: np.ndarray, documents: int, total: int, k: int, run_documents: int = RUN_DOCUMENTS) -> DataFrame:
    """``item, doc_id, score``: for each task and item the best ``k`` of the task's documents."""
    order = [np.lexsort((t, -weights[t])) for t in queries.terms]
    asked = [(t[o], weights[t[o]] * r[o]) for t, r, o in zip(queries.terms, queries.repeats, order, strict=True)]
    shared = postings.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(asked)
        held, size = [], 0

        def search() -> None:
            ids = np.concatenate([h[0] for h in held])
            part = Run(*(np.concatenate([h[i] for h in held]) for i in range(1, 5)), documents, total)
            for i, (terms, own) in enumerate(asked):
                old_ids, old = best[i]
                docs, scores = part.search(terms, own, k, int(old[-1]) if len(old) == k else 0)
                if len(docs):
                    best[i] = _best(np.r_[old_ids, ids[docs]], np.r_[old, scores], k)

        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values.fill_null(_NO_ID).to_numpy()
                held.append((ids, batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy(), *(_large(batch.column(c)[i].as_py()) for c in (3, 4))))
                size += len(ids)
                if size >= run_documents:
                    search()
                    held, size = [], 0
        if held:
            search()
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        ids, scores = (np.concatenate([b[i] for b in best] or [none]) for i in (0, 1))
        yield pa.record_batch([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    queries = queries_of(rows)
    postings = stored(make_postings(docs, queries.hashes), "search-postings")
    whole = postings.select(F.size("sizes").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    documents, total = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    weights = weights_of(documents, document_counts(postings, len(queries.hashes)))
    found = best_of_tasks(postings, queries, weights, documents, total, k)
    merged = _ranked(found.withColumn("part", F.spark_partition_id() % MERGES), k, "item", "part").drop("rank")
    best = _ranked(merged, k, "item")
    names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), "item long, item_id long")
    # One row for each item of the block.
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST, most: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents for each item row."""
    spark = docs.sparkSession
    parts: list[DataFrame] = []
    for rows in blocks_of(items, most, chars):
        # A block is done before the next is read: its postings depend on its terms.
        parts.append(stored(search_block(docs, rows, k), "search-best"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def oracle() -> str:
    """DuckDB SQL for ``rank_documents`` over ``documents`` and ``benchmark``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
size AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, SUM(n)::BIGINT AS words FROM size),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) AS t GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
item AS (SELECT row_number() OVER () AS q, item_id, {terms} AS terms FROM benchmark),
asked AS (SELECT q, item_id, term, count(*)::BIGINT AS qtf FROM (SELECT q, item_id, unnest(terms) AS term FROM item) AS t GROUP BY q, item_id, term),
weighed AS (SELECT q, item_id, term, qtf * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term) CROSS JOIN total),
scored AS (
  SELECT q, item_id, doc_id, r, SUM(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
  FROM weighed JOIN tf USING (term) JOIN size USING (r) CROSS JOIN total GROUP BY q, item_id, doc_id, r),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
