"""Alignment against loops over the two tokenizers' offsets."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import odd
import public_tokenizers
import pytest
from quirekit.llm import cross_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    vocabulary = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    alphabet = cross_align.byte_alphabet()

    def both(text):
        """``(id, bytes)`` of both sides, or nothing."""
        if not text:
            return [], []
        left = [(i, bytes(alphabet[c] for c in vocabulary[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if b"".join(x[1] for x in left) == whole == b"".join(x[1] for x in right) else ([], [])

    return both


def brute(rows, both):
    counts, found = Counter(), []
    for row in rows:
        left, right = both(row.text)
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        links, groups, start, j = [], [], 0, 0
        for i, low, high in spans[0]:
            while j and spans[1][j - 1][2] > low:
                j -= 1
            while j < len(spans[1]) and spans[1][j][2] <= low:
                j += 1
            while j < len(spans[1]) and spans[1][j][1] < high:
                links.append((i, spans[1][j][0]))
                j += 1
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, low, high in side if start <= low and high <= end) for side in spans))
            start = end
        counts.update(links)
        text = ";".join(groups)
        found.append((row.doc_id, len(left), len(right), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = [(str(d), a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, a, b, g, links, sha in found]
    return sorted(rows), counts, most


def shown(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


AWKWARD = ["\tone", " two  spaces  ", "line\n\nline \n", "a▁b", "x\rz {\r\n", "\x85next\xa0word", "\U0001f642 漢字 é", "<|endoftext|> <s> <unk> <0x41>", "\x00", " ", "\n",
           "café " * 3, "　wide", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12 345,678.90", "don't we'll", "​zero ﻿mark", "x" * 3000]


def test_stored_rows_in_blocks(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000").select("doc_id", "text").repartition(3)
    rows = docs.collect()
    made = cross_align.Alignment(docs, A, B, block_bytes=20_000)
    want, counts, most = brute(rows, libraries)
    assert made.blocks.count() > 6 and shown(made.documents()) == want
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in made.pairs().collect()} == {p: (n, n == most[p[1]]) for p, n in counts.items()}


def test_odd_rows(spark, docs, no_docs, libraries):
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000] + spark.createDataFrame([(100 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string").collect()
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    assert shown(cross_align.align_documents(frame, A, B)) == brute(rows, libraries)[0]
    assert cross_align.align_documents(docs, A, B).count() == docs.count()
    assert cross_align.align_documents(no_docs, A, B).count() == 0


def test_units_are_cut_where_no_token_spans(libraries):
    known = cross_align.aligner(A, B)
    for text in AWKWARD + [odd.PROSE, odd.LONG[:5000]]:
        units = known.units_of(text)
        assert "".join(units) == " " + text
        left, right = libraries(text)
        if left:
            got = [known._alone(u) for u in units]
            assert [i for a, _ in got for i in a] == [i for i, _ in left] and [i for _, b in got for i in b] == [i for i, _ in right]


def test_store_is_forgotten(spark, libraries, monkeypatch):
    """A store that is emptied after every block gives the same rows."""
    known = cross_align.Aligner(A, B)
    block = cross_align.Block(known)
    import pyarrow as pa

    for _ in range(2):
        block.add(pa.array([1, 2]), ["one two one", "two"])
        first = block.row(0)
        known.forget()
        block = cross_align.Block(known)
    block.add(pa.array([1, 2]), ["one two one", "two"])
    assert block.row(0) == first


def test_identity_map(libraries):
    known = cross_align.aligner(A, B)
    for i in range(0, len(known.a_bytes), 97):
        j = known.identity[i]
        assert known.b_bytes[j] == known.a_bytes[i] if j >= 0 else known.a_bytes[i] not in known.b_bytes


def test_counting_lets_go_of_the_tokenizers():
    """A worker that has encoded keeps neither tokenizers nor units while it counts; blocks and the identity map suffice."""
    import pyarrow as pa

    known = cross_align.aligner(A, B)
    block = cross_align.Block(known)
    block.add(pa.array([1, 2]), ["some words, some unusual wordlings", "some more"])
    rows = [block.row(0)]
    assert cross_align.aligner.cache_info().currsize == 1
    got = [r for batch in cross_align._counted(iter(rows), known.kind, known.identity) for r in batch.to_pylist()]
    assert cross_align.aligner.cache_info().currsize == 0
    assert sum(r["n"] for r in got) == sum(v.sum() for v in (s[3] for s in block.sums)) and {r["block"] for r in got} <= {0, None}


def _bound_rows():
    """Texts of words that never come again, and texts without a place to cut them."""
    return [" ".join(f"w{i}x{j * 7919}" for j in range(300)) for i in range(12)] + [" ".join(f"v{i}y{j}\u3000z" for j in range(200)) for i in range(12)]


def test_units_are_counted_with_all_they_hold():
    """What a store reports is no less than its texts, printed groups and links: a text that is one unit is mostly the latter."""
    known = cross_align.Aligner(A, B)
    for text in _bound_rows():
        known.numbers_of(known.units_of(text))
    held = sum(len(u.encode()) for u in known.known) + sum(map(len, known.groups)) + known.link_a.values.nbytes + known.link_b.values.nbytes
    assert held < known.bytes_kept < 10 * held


def test_blocks_end_where_the_store_is_full(libraries, monkeypatch):
    """A store holds no more than its bound and one batch of texts, and the blocks it ends give the same documents."""
    import pyarrow as pa

    monkeypatch.setattr(cross_align, "STORE_BYTES", 200_000)
    monkeypatch.setattr(cross_align, "_WORK_BYTES", 4_000)
    known = cross_align.Aligner(A, B)
    texts = _bound_rows()
    most, learn = [0], known._learn

    def watched(units):
        learn(units)
        most[0] = max(most[0], known.bytes_kept)

    monkeypatch.setattr(known, "_learn", watched)
    rows = list(cross_align._blocks(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]), known, 5, 1 << 30))
    assert len(rows) > 3 and 200_000 < most[0] < 600_000
    assert [r.column("block")[0].as_py() for r in rows] == list(range(5, 5 + len(rows)))
    got = [x for r in rows for x in zip(*(r.column(c)[0].as_py() for c in ("doc_ids", "n_a", "n_b", "digests")), strict=True)]
    want = []
    for i, text in enumerate(texts):
        left, right = libraries(text)
        want.append((i, len(left), len(right)))
    assert [g[:3] for g in got] == want
    whole = cross_align.Block(cross_align.Aligner(A, B))
    whole.add(pa.array(range(len(texts))), texts)
    assert [g[3] for g in got] == whole.digests


def test_a_row_group_is_one_block(spark):
    """Blocks are megabytes each; a file that holds many is neither gathered nor read as one."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"some words of text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    made = cross_align.Alignment(docs, A, B, block_bytes=5_000)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made.blocks.inputFiles()]
    assert max(f.num_rows for f in files) > 3 and all(f.num_row_groups == f.num_rows for f in files)
