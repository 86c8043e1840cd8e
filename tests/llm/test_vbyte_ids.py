from __future__ import annotations

import inspect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quirekit.llm import vbyte_ids as vb
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 1 << 16), st.integers(0, (1 << 32) - 1)), max_size=60))
def test_coding_round_trip(values):
    array = np.array(values, "<u4")
    control, data = vb.encode(array)
    assert vb.decode(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values) + -len(values) % 4


def check(frame, rows, library):
    got = [(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in frame.collect()]
    want, start = [], 0
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u2").tobytes()))
    for r in order:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((start, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[0]) == want


def test_stored_rows(table, library):
    docs, rows = table("documents")
    check(vb.round_trip(docs, FILE), rows, library)


def test_odd_rows(docs, no_docs, library):
    check(vb.round_trip(docs, FILE), docs.collect(), library)
    assert vb.round_trip(no_docs, FILE).count() == 0


def test_tokens_like_the_library_on_all_scripts(library):
    rng = random.Random(3)
    pools = ["abcXYZ'.,!? \n\t", "äöüßÉÇñŁĳǅ€—…’", "ЖжЁыйѐ", "漢字かなカナ一", "İıΣςσέ́­ \x1c\x85\xa0", "<|startoftext|>", "'S'T'LL 12٣²½", "😀🏽‍"]
    encode = vb._encoder(FILE)
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text
        assert encode([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text)


def test_every_plain_character(library):
    encode = vb._encoder(FILE)
    plain = [chr(c) for c in range(0xA000) if not vb._PLAIN.search(chr(c))]
    for i in range(0, len(plain), 50):
        text = "a".join(plain[i : i + 50]) + " ".join(plain[i : i + 50]) + "".join(plain[i : i + 50])
        assert encode([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text)


def test_commonest_ids_take_one_byte(spark, table, tmp_path):
    docs, _ = table("documents")
    vb.write(docs, FILE, str(tmp_path / "set"))
    ranks = {r.rank: r.id for r in spark.read.parquet(str(tmp_path / "set/ranks")).collect()}
    counts = {}
    for r in vb.read(spark, str(tmp_path / "set")).collect():
        for i in np.frombuffer(r.ids, "<u4").tolist():
            counts[i] = counts.get(i, 0) + 1
    ordered = [counts[ranks[k]] for k in range(len(ranks))]
    assert ordered == sorted(ordered, reverse=True) and set(ranks.values()) == set(counts)


def test_words_are_encoded_without_offsets(library, monkeypatch):
    import tokenizers

    called = []

    class Watched:
        def __init__(self, inner):
            object.__setattr__(self, "inner", inner)

        @staticmethod
        def from_file(file):
            return Watched(Tokenizer.from_file(file))

        def __getattr__(self, name):
            called.append(name)
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    text = "Plain words, it's 12 of them \u0644 <|endoftext|>"
    got = vb._encoder.__wrapped__(FILE)(["Plain words, it's 12 of them", text])
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in ("Plain words, it's 12 of them", text)]
    assert "encode_batch_fast" in called and not {"encode", "encode_batch"} & set(called)


def test_early_words_outlast_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(vb, "REMEMBERED", 6)
    encode = vb._encoder.__wrapped__(FILE)
    texts = ["alpha", "beta gamma, delta 12 epsilon. it's zeta-eta", "theta", "it's gamma, __ zeta-eta"]
    for text in texts:
        assert np.frombuffer(encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert inspect.getclosurevars(encode).nonlocals["known"].get("alpha")
