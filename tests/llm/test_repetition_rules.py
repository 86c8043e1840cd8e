"""Repetition coverage against loops over words and lines."""

from __future__ import annotations

import random
import re

import odd
import pyarrow as pa
import pytest
from quirekit.llm import repetition_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, WORD.findall(line)))
            seen.add(line)
    for n in (3, *rules.LENGTHS):
        places = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        inside = {i + j for p in places.values() for i in (p if len(p) > 1 and n == 3 else p[1:]) for j in range(n)}
        if n == 3:
            out["n_repeat_words"] = len(inside)
        else:
            out[f"dup_chars_{n}"] = sum(len(words[i]) for i in inside)
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    over = any(100 * out[f"dup_chars_{n}"] > rules.LIMITS[n] * out["word_chars"] for n in rules.LENGTHS)
    over = over or 100 * out["dup_line_chars"] > rules.LIMITS["lines"] * out["word_chars"] or 100 * out["n_symbols"] > rules.LIMITS["symbols"] * len(words)
    out["kept"] = not out["base_failed"] and not over
    return out


def shown(rows):
    return sorted((str(r.doc_id), sorted((k, v) for k, v in r.asDict().items() if k != "doc_id")) for r in rows)


def expected(rows):
    return sorted((str(r.doc_id), sorted(brute(r.text).items())) for r in rows)


def test_stored_rows(table):
    docs, rows = table("documents")
    got = rules.judge_documents(docs).collect()
    assert shown(got) == expected(rows)
    assert any(r.kept for r in got) and any(not r.kept and not r.base_failed for r in got)


def test_odd_rows(docs, no_docs):
    got = rules.judge_documents(docs)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert shown(got.collect()) == expected(docs.collect())
    assert rules.judge_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_batches_of_small_alphabets(seed):
    """Few words and many lines, so that windows repeat at every length, across text borders in one batch too."""
    draw = random.Random(seed)
    words = ["a", "bb", "é", "漢字", "#*", "A"][: 2 + seed % 5]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "  ", "\n", "\n\n", "\t"]) for _ in range(draw.randrange(40))) for _ in range(50)]
    got = rules.counts_of(pa.array(texts))
    for i, text in enumerate(texts):
        want = brute(text)
        assert {c: int(got[c][i]) for c in rules.COUNTS} == {c: want[c] for c in rules.COUNTS}, text


def test_clean_documents_stay(table, spark):
    """Documents labelled as good prose stay unless they are too short or repeat themselves by the base rule."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.judge_documents(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.35 * len(bad)


def test_no_shuffle(docs):
    assert "Exchange" not in rules.judge_documents(docs)._jdf.queryExecution().executedPlan().toString()
