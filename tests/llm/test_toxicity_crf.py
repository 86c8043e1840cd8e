from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
from quirekit.llm import toxicity_crf as crf


def brute(scores, moves):
    """Marginals and expected moves by summing over all state sequences."""
    total, marginal, pairs = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=len(scores)):
        # The first token comes from either state alike.
        weight = sum(math.exp(moves[s][states[0]]) for s in (0, 1)) * math.exp(scores[0] * states[0])
        for i in range(1, len(scores)):
            weight *= math.exp(moves[states[i - 1]][states[i]] + scores[i] * states[i])
        total += weight
        marginal += weight * np.array(states)
        for a, b in itertools.pairwise(states):
            pairs[a, b] += weight
    return marginal / total, pairs / total


def test_chain_equals_sum_over_sequences():
    rng = np.random.default_rng(3)
    moves = rng.normal(size=(2, 2))
    texts = [rng.normal(size=n) * 2 for n in (5, 0, 1, 9)]
    begin = np.r_[0, np.cumsum([len(t) for t in texts])]
    got, expected = crf.chain(np.concatenate(texts), begin, moves)
    want = [brute(t, moves) for t in texts if len(t)]
    assert np.allclose(got, np.concatenate([w[0] for w in want]))
    assert np.allclose(expected, sum(w[1] for w in want))


def test_pieces_do_not_change_a_long_chain(monkeypatch):
    rng = np.random.default_rng(4)
    scores, begin, moves = rng.normal(size=700), np.array([0, 500, 500, 700]), rng.normal(size=(2, 2))
    whole = crf.chain(scores, begin, moves)
    monkeypatch.setattr(crf, "_PIECE", 7)
    small = crf.chain(scores, begin, moves)
    assert np.allclose(whole[0], small[0]) and np.allclose(whole[1], small[1])


def corpus():
    filler = ["river", "stone", "lamp", "door", "miller", "grain", "cloud", "field", "road", "bridge"]
    forms = ["an", "el", "ic", "or", "us", "em"]
    rng = np.random.default_rng(5)
    out = []
    for i in range(300):
        words = [f"{rng.choice(filler)}{rng.integers(40)}" for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[7] = "dolt"
            words[20] = f"grumf{rng.choice(forms)}"
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_finds_words_and_unseen_forms(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "a lamp and a grumfzoid door"), (1001, "a lamp and a door"), (1002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in crf.predict_documents(docs, labels).collect()}
    assert all(got[i].predicted == toxic for i, _, toxic in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].predicted == 0
    text = "a lamp and a grumfzoid door"
    assert [text[s.start : s.end] for s in got[1000].spans] == ["grumfzoid"]
    kept = {r.doc_id for r in crf.clean_documents(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_held_out_labels_change_nothing(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in rows]
    a = crf.predict_documents(docs, spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int"))
    b = crf.predict_documents(docs, spark.createDataFrame(flip, "doc_id long, quality int, toxic int"))
    assert sorted((r.doc_id, r.score) for r in a.collect()) == sorted((r.doc_id, r.score) for r in b.collect())


def test_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert crf.predict_documents(docs, labels).count() == docs.count()
    assert crf.predict_documents(no_docs, labels).count() == 0
    none = labels.limit(0)
    scores = [r.score for r in crf.predict_documents(docs, none).collect()]
    assert len(scores) == docs.count() and max(scores) < 1e-6
    kept = crf.clean_documents(docs, none)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert crf.clean_documents(no_docs, labels).count() == 0


def test_held_out_accuracy_on_stored_rows(spark):
    """At a hundredth of a unit most toxic words are seen; labels without any toxic word cannot be told."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = crf.predict_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert not any(r.predicted and not r.toxic for r in got)
