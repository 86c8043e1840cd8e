from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from quirekit.llm import byte_bpe as bpe

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(frame, rows, library):
    got = sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in frame.collect())
    want = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want.append(str((r.doc_id, len(ids), bpe.sha256_of(ids), hashlib.sha256((r.text or "").encode()).hexdigest())))
    assert got == sorted(want)


def test_stored_rows(table, library):
    docs, rows = table("documents")
    check(bpe.digests(docs, FILE, PATTERN), rows, library)


def test_odd_rows_and_small_blocks(docs, no_docs, library, monkeypatch):
    check(bpe.digests(docs, FILE, PATTERN), docs.collect(), library)
    assert bpe.digests(no_docs, FILE, PATTERN).count() == 0
    twice = docs.union(docs).coalesce(2)
    check(bpe.digests(twice, FILE, PATTERN), twice.collect(), library)


def test_split_like_the_library_on_all_scripts(spark, library):
    """Every assigned character, alone and between others; the two pattern engines must part texts alike."""
    import unicodedata

    known = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    rng = random.Random(1)
    rows = [(i, "".join(known[i : i + 300])) for i in range(0, len(known), 300)]
    rows += [(10**6 + i, "".join(rng.choice([" ", "  ", "\n", "'s", "a", "1", rng.choice(known)]) for _ in range(200))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(bpe.digests(frame, FILE, PATTERN), frame.collect(), library)


def test_decoding_by_table(library):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_256, 1000)
    assert bpe.decoded(ids, FILE) == library.decode_bytes(ids.tolist())
    assert bpe.decoded(np.zeros(0, np.int64), FILE) == b""
