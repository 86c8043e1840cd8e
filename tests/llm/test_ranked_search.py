"""Accumulator-limited search against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from quirekit.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = [t for t in terms(text) if df[t]]
        scores = []
        for d, tf, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(str(item), rank, str(d), -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def shown(frame):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in frame.collect())


def test_stored_rows(table):
    docs, rows = table("documents")
    items, asked = table("benchmark")
    got = search.rank_documents(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert shown(got) == brute([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in asked])


def test_blocks_of_items(table):
    docs, rows = table("documents")
    items, asked = table("benchmark")
    got = search.rank_documents(docs.limit(60), items, k=3, most=7)
    assert shown(got) == brute([(r.doc_id, r.text) for r in docs.limit(60).collect()], [(r.item_id, r.text) for r in asked], 3)
    assert [len(b) for b in search.blocks_of(items, 7)] == [7] * 5 + [5]


def test_odd_rows(spark, docs, no_docs):
    items = spark.createDataFrame([(0, "The MILL, mill;漢字 one", 1), (1, None, 1), (2, "", 1), (3, "nowhere to"[:7], 1), (4, "word1", 1), (4, "word1", 1), (None, "text id", 1)], "item_id long, text string, score int")
    got = search.rank_documents(docs, items)
    assert shown(got) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert search.rank_documents(no_docs, items).count() == 0
    assert search.rank_documents(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_runs_keep_every_best_document(seed):
    """One run with many ties: what the search gives holds all of the best k, with full scores."""
    draw = np.random.default_rng(seed)
    size, vocabulary, k = 400, 30, 5
    weights = np.sort(draw.integers(0, 50, vocabulary))[::-1] * (1 if seed % 2 else 100)
    tf = draw.integers(0, 3, (size, vocabulary)) * (draw.random((size, vocabulary)) < np.linspace(0.02, 0.9, vocabulary))
    sizes = tf.sum(1) + draw.integers(1, 5, size)
    total = int(sizes.sum())
    owner, term = np.nonzero(tf)
    run = search.Run(sizes, np.bincount(owner, minlength=size), term, tf[owner, term], size, total)
    norms = search.length_norms(sizes, size, total)
    full = (weights * (1_000_000_000 * tf // (1000 * tf + 12 * norms[:, None]))).sum(1)
    docs, scores = run.search(np.arange(vocabulary), weights, k, 0)
    assert (full[docs] == scores).all()
    kth = np.sort(full)[-k]
    assert set(np.flatnonzero((full >= kth) & (full > 0))) <= set(docs.tolist())
    docs, scores = run.search(np.arange(vocabulary), weights, k, int(np.sort(full)[-2]))
    assert set(np.flatnonzero(full >= np.sort(full)[-2])) <= set(docs.tolist()) and (full[docs] == scores).all()


def test_small_runs_share_the_kth_score(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(words, weights=range(1, 41), k=draw.randrange(30)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = [(0, "w1 w39 w38 w0"), (1, "w20 w20 w3")]
    queries = search.queries_of(items)
    postings = search.stored(search.make_postings(docs, queries.hashes), "test")
    n, total = sum(bool(t) for _, t in rows), sum(len(terms(t)) for _, t in rows)
    weights = search.weights_of(n, search.document_counts(postings, len(queries.hashes)))
    small = search.best_of_tasks(postings, queries, weights, n, total, 4, run_documents=20)
    got = search._ranked(small, 4, "item")
    assert sorted((str(r.item), r["rank"], str(r.doc_id), r.score) for r in got.collect()) == brute(rows, items, 4)


def test_norms_beyond_64_bits():
    sizes = np.array([1, 10**9, 7])
    assert search.length_norms(sizes, 10**12, 10**15).tolist() == [75 + 25 * int(n) * 10**12 // 10**15 for n in sizes]
