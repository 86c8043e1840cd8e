from __future__ import annotations

import itertools
import re

import numpy as np
from quirekit.llm import spaced_seeds as seeds

WORDS = [f"tok{i}" for i in range(3000)]


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Every offset of every item on every text."""
    found = set()
    for doc, text in docs:
        a = np.array(tokens(text), object)
        for item, wording in items:
            b = np.array(tokens(wording), object)
            if len(b) >= seeds.LEAST and any(seeds.best_stretch(a, b, o) for o in range(1 - len(b), len(a))):
                found.add((doc, item))
    return found


def passage(rng, n):
    return [str(w) for w in rng.choice(WORDS, n)]


def fixture():
    rng = np.random.default_rng(11)
    items = [(i, " ".join(passage(rng, int(n)))) for i, n in enumerate((30, 45, 13, 20, 9, 6, 4, 60))]
    docs = []
    for k in range(40):
        words = passage(rng, 80)
        item = tokens(items[k % len(items)][1])
        if k % 2:
            for swap in range(0, k // 8):
                item[(swap * 7 + 3) % len(item)] = "changed"
            words[40:40] = item
        docs.append((k, ", ".join(words).title()))
    docs += [(90, items[0][1]), (91, " ".join(tokens(items[1][1])[:14])), (92, " ".join(tokens(items[1][1])[:12])), (93, "")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    got = seeds.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    whole = next(r for r in got if (r.doc_id, r.item_id) == (90, 0))
    assert (whole.start, whole.n_tokens, whole.n_equal) == (0, 30, 30)
    assert (91, 1) in {(r.doc_id, r.item_id) for r in got} and 92 not in {r.doc_id for r in got}


def test_equals_brute_force_on_stored_rows(spark, table):
    docs, rows = table("documents")
    items, item_rows = table("benchmark")
    got = {(r.doc_id, r.item_id) for r in seeds.overlaps(docs, items).collect()}
    # A shared stretch of 13 tokens with a share of 0.8 has a run of three equal tokens, which bounds what brute force tries.
    runs = {i: {tuple(t[j : j + 3]) for j in range(len(t) - 2)} for i, t in ((r.item_id, tokens(r.text)) for r in item_rows)}
    tried = set()
    for d in rows:
        t = tokens(d.text)
        own = {tuple(t[j : j + 3]) for j in range(len(t) - 2)}
        near = [(r.item_id, r.text) for r in item_rows if len(own & runs[r.item_id]) >= 2]
        tried |= brute([(d.doc_id, d.text)], near)
    assert got == tried and got


def test_stretch_rules():
    a = np.arange(40)
    assert seeds.best_stretch(a, a[5:30], 5) == (5, 25, 25)
    b = a[5:30].copy()
    b[[4, 9, 14, 19]] = -1
    assert seeds.best_stretch(a, b, 5) == (5, 25, 21)
    assert seeds.best_stretch(a, a[5:17], 5) == (5, 12, 12)
    assert seeds.best_stretch(a, a[5:30], 0) is None
    assert seeds.best_stretch(a[:5], a[:30], 10) is None


def test_odd_rows(spark, docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the river ran past the old mill and the miller counted sacks"), (None, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in seeds.overlaps(docs, items).collect()}
    assert got == {(0, 3), (5, 3), (6, 3), (10, 3)}
    clean = seeds.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 4
    assert seeds.overlaps(no_docs, items).count() == 0
    assert seeds.overlaps(docs, items.limit(0)).count() == 0
    assert seeds.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_longest_stretch_is_not_hidden_by_a_longer_run_with_bad_ends():
    """12 equal tokens at 4-15 extend to a longer run that shrinks below the least; the stretch at 30-42 counts."""
    item = np.arange(60)
    text = item.copy()
    text[[*range(4), *range(16, 30), *range(43, 60)]] = -1
    assert seeds.best_stretch(text, item, 0) == (30, 13, 13)


def test_stretch_equals_all_pairs_of_ends():
    rng = np.random.default_rng(2)
    for _ in range(300):
        item = np.arange(int(rng.integers(14, 60)))
        text = np.where(rng.random(len(item)) < rng.choice([0.6, 0.75, 0.85]), item, -1)
        same = text == item
        sums = np.r_[0, np.cumsum(same)]
        sizes = [e - s for s in range(len(item)) for e in range(s + seeds.STRETCH, len(item) + 1) if same[s] and same[e - 1] and 5 * (sums[e] - sums[s]) >= 4 * (e - s)]
        got = seeds.best_stretch(text, item, 0)
        assert (got[1] if got else None) == (max(sizes) if sizes else None)


def test_masks_miss_no_placement_of_swaps():
    """All ways to swap as many tokens as the rule allows leave a window of some mask whole."""
    for size in range(seeds.SPAN, 21):
        swaps = size // 5
        windows = [sum(1 << at + i for i, c in enumerate(mask) if c == "1") for mask in seeds.masks_for(size) for at in range(size - len(mask) + 1)]
        for places in itertools.combinations(range(size), swaps):
            lost = sum(1 << p for p in places)
            assert any(not w & lost for w in windows), (size, places)


def test_short_items_with_one_token_swapped(spark):
    item = [f"w{i}" for i in range(8)]
    docs = [(i, " ".join(["pre", *item[:i], "other", *item[i + 1 :], "post"])) for i in range(8)]
    got = seeds.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_equal) for r in got} == {(i, 8, 7) for i in range(8)}
