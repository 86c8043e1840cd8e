from __future__ import annotations

import itertools
import random
import re

import corpus_pipeline
import pytest
from quirekit.llm import common, near_copies, simhash_pivots

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def parts(texts):
    """Groups of row numbers linked by a Jaccard similarity of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = len(sets[i]), len(sets[j])
        if 5 * min(a, b) >= 4 * max(a, b) and (n := len(sets[i] & sets[j])) * 5 >= 4 * (a + b - n):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def swapped(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_stage_links_copies_with_swapped_words(spark):
    rng = random.Random(5)
    texts = []
    for size, places in ((100, (50,)), (200, (60, 140)), (100, (30, 70)), (100, (20, 50, 80))):
        for _ in range(40):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += [" ".join(words), swapped(words, places)]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF).collect()}
    assert kept == {min(g) for g in parts(texts)}


@pytest.mark.parametrize("chunk", [3, 1024])
def test_chains_and_large_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [swapped(base, rng.sample(range(120), 2)) for _ in range(60)]
    chain = base[::-1]
    for i in range(20):
        chain = chain[:6 * i] + [f"c{i}"] + chain[6 * i + 1 :]
        texts.append(" ".join(chain))
    kept = {r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {min(g) for g in parts(texts)}


def test_stored_rows_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    kept = sorted(r.doc_id for r in near_copies.one_of_each(docs).select("doc_id").collect())
    assert kept == sorted(rows[min(g)].doc_id for g in parts([r.text for r in rows]))


def test_odd_rows(docs, no_docs):
    rows, kept = docs.collect(), near_copies.one_of_each(docs)
    stayed = {(r.doc_id, r.text) for r in kept.collect()}
    groups = parts([r.text for r in rows])
    assert kept.columns == docs.columns and kept.count() == len(groups) == len(stayed)
    assert all(len({(rows[i].doc_id, rows[i].text) for i in g} & stayed) == 1 for g in groups)
    assert near_copies.one_of_each(no_docs).count() == 0


def test_simhash_search_links_close_copies_alone(spark, monkeypatch):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(600)] for _ in range(30)]
    texts = [" ".join(words) for words in base] + [swapped(words, (300,)) for words in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "shared_buckets", lambda distinct: distinct.selectExpr("0L AS bucket", "0 AS band", "fp").limit(0))
    kept = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    # A few pairs differ in more bits than the radius; those are the bands' part.
    assert {min(g) for g in parts(texts)} == set(range(30)) <= kept and len(kept) <= 35


def test_bands_compare_only_what_the_simhash_search_left(spark, monkeypatch):
    rng, seen = random.Random(8), []
    base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = [swapped(base, (i,)) for i in range(50, 4000, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    monkeypatch.setattr(near_copies, "split_buckets", lambda rows, chunk: seen.append(rows.count()) or simhash_pivots.split_buckets(rows, chunk))
    assert [r.doc_id for r in near_copies.one_of_each(docs).collect()] == [0] and seen == [0, 0]


def test_texts_are_not_shuffled_to_find_few_of_them(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], None])), "doc_id long, text string")
    wanted = docs.select("doc_id", near_copies.mark_of("text").alias("mark")).where("doc_id < 3")
    plan = near_copies.sets_of(docs, wanted)._jdf.queryExecution().optimizedPlan().toString()
    # A key joins the bitmap's words only, which are broadcast; no join by the id itself.
    assert "LeftSemi" not in plan and "strategy=broadcast" in plan
    assert near_copies.sets_of(docs, wanted).count() == 3
    left = near_copies.one_of_each(docs)
    assert "strategy=broadcast" in left._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in left.collect()) == [*range(40), 41]


def test_crowded_bitmap_changes_no_result(spark, docs, monkeypatch):
    kept = sorted(near_copies.one_of_each(docs).collect(), key=repr)
    monkeypatch.setattr(common, "BITMAP_WORDS", 1)
    assert sorted(near_copies.one_of_each(docs).collect(), key=repr) == kept
