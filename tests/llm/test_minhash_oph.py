from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from quirekit.llm import minhash_oph as oph


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows):
    """Row by row: the text, and the one that follows in descending order of id (ties: of text)."""
    order = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode(), r.doc_id, r.text or "") for r in rows))
    out = []
    for i, (*_, doc, text) in enumerate(order):
        following = order[i - 1][-1]
        n = len(text) // 3
        out.append((doc, text, text[: len(text) - n] + following[:n], following))
    return out


def check(frame, rows):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in frame))
    want = sorted((d is not None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in expected(rows))
    assert got == want


def test_stored_rows(table):
    docs, rows = table("documents")
    got = oph.compare_with_next(docs).collect()
    check(got, rows)
    by_id = {r.doc_id: r for r in got}
    errors = []
    for doc, text, edit, following in expected(rows):
        errors.append(by_id[doc].near_edited - jaccard(text, edit))
        errors.append(by_id[doc].near_next - jaccard(text, following))
    assert np.mean(np.abs(errors)) < 0.02 and abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.2
    texts = {}
    for r in rows:
        assert texts.setdefault(r.text, by_id[r.doc_id].fingerprint) == by_id[r.doc_id].fingerprint


@pytest.mark.parametrize("share", [0.1, 0.5, 0.8, 0.95])
def test_bias_is_corrected(share):
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        n = 400
        same = round(n * 2 * share / (1 + share))
        common = [f"c{i}" for i in rng.integers(0, 10**9, same)]
        a, b = ([f"{k}{i}" for i in rng.integers(0, 10**9, n - same)] for k in "ab")
        # Words that stand five in a row only in their own text, so shingles are shared in the common run alone.
        x, y = (" ".join(common + own) for own in (a, b))
        fa, fb = oph.printed([x, y])
        errors.append(oph.likeness(fa, fb) - jaccard(x, y))
    assert abs(np.mean(errors)) < 0.02


def test_densify_takes_the_first_full_bin_in_order():
    table = np.full((3, oph.BINS), oph._NONE, np.uint64)
    table[0, [5, 9]] = [50, 90]
    rng = np.random.default_rng(2)
    full = np.sort(rng.choice(oph.BINS, 40, replace=False))
    table[1, full] = np.arange(40)
    out = oph.densify(table)
    for row in (0, 1):
        for b in range(oph.BINS):
            own = table[row, b] if table[row, b] != oph._NONE else next(table[row, c] for c in oph._ORDER[b] if table[row, c] != oph._NONE)
            assert out[row, b] == own
    assert (out[2] == oph._NONE).all()


def test_odd_rows(docs, no_docs, spark):
    rows = docs.collect()
    got = oph.compare_with_next(docs).collect()
    check(got, rows)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert oph.compare_with_next(no_docs).count() == 0
    one = oph.compare_with_next(spark.createDataFrame([(4, "some words for one text")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    assert oph.fingerprint_documents(docs).count() == len(rows)
