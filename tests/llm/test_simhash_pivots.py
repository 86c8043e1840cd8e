from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quirekit.llm import simhash_pivots as sim


def print_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    """Least id reachable by links of at most four bits; ``prints`` is a list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(doc, known)
    return [(doc, f"{p:016x}", least[find(i)]) for i, (doc, p) in enumerate(prints)]


def as_set(rows):
    return sorted(map(str, ((r[0], r[1], r[2]) for r in rows)))


def test_stored_rows(table):
    docs, rows = table("documents")
    got = sim.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert as_set(got) == as_set(components([(r.doc_id, print_of(r.text)) for r in rows]))


def test_odd_rows(docs, no_docs):
    rows = docs.collect()
    got = sim.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert as_set(got) == as_set(components([(r.doc_id, print_of(r.text)) for r in rows]))
    assert sim.near_duplicates(no_docs).count() == 0
    kept = sim.one_of_each(docs)
    assert kept.columns == docs.columns
    # Components of rows rather than of ids, since two of the rows differ but share an id.
    parts = components([(i, print_of(r.text)) for i, r in enumerate(rows)])
    groups = {}
    for i, _, part in parts:
        groups.setdefault(part, set()).add((rows[i].doc_id, rows[i].text))
    stayed = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(stayed) == len(groups) and all(len(g & set(stayed)) == 1 for g in groups.values())
    for group in groups.values():
        ids = [i for i, _ in group if i is not None]
        assert not ids or min(ids) in {i for i, _ in group & set(stayed)}
    assert sim.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("chunk", [3, 4096])
def test_links_of_planted_fingerprints(spark, chunk):
    """Chains, dense groups and lone fingerprints, whole buckets and split ones."""
    rng = np.random.default_rng(9)
    lone = [int(x) for x in rng.integers(0, 1 << 62, 200)]
    chain = [lone[0]]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    dense = [lone[1] ^ sum(1 << b for b in range(8) if m >> b & 1) for m in range(256)]
    prints = list(dict.fromkeys([*lone, *chain, *dense, 0, (1 << 64) - 1, 15, 31]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    cells = sim.split_buckets(sim.table_rows(frame), chunk)
    found = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(sim._search, "u long, v long").distinct()
    edges = {(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in found.collect()}
    # A star for each component of a cell: no more edges than rows.
    assert len(edges) <= cells.count()
    want = {r[0]: r[2] for r in components(list(zip(prints, prints, strict=True)))}
    got = dict(zip(prints, prints, strict=True))
    roots = {r.u & (1 << 64) - 1: r.root for r in sim.components(found).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(p, p if p < 1 << 63 else p - (1 << 64)), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(p for p in got if want[p] == w) for w in set(want.values())}


def test_close_pairs_equal_brute_force():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(15)], np.uint64)
    groups = np.sort(rng.integers(0, 4, len(fps)))
    left, right = sim.close_pairs(groups, fps)
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if groups[i] == groups[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)} == want


def test_blocks_read_off_pivots():
    fps = np.random.default_rng(12).integers(0, 1 << 63, 50, np.uint64)
    for i, values in enumerate(sim.block_values(fps)):
        bits = ~(fps ^ sim.BASE) & sim.MASKS[i]
        assert len(set(zip(values.tolist(), bits.tolist(), strict=True))) == len(set(values.tolist())) == len(set(bits.tolist()))


def test_long_chain_of_edges(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = sim.components(edges).collect()
    assert {r.u for r in got} == set(range(1, n)) and {r.root for r in got} == {0}
