from __future__ import annotations

import random
import re

from quirekit.operators.running import best_per_key


def test_best_row_of_each_key(spark):
    rng = random.Random(5)
    lines = ["Chapter 1", "Chapter One", "chapter ONE", "Chapter One.", "", "12", "é", None]
    # One key holds most rows; another has no known line at all.
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(lines), rng.randint(0, 30), i, "x") for i in range(300)]
    rows += [("none", None, 4, 0, "x"), ("none", None, 2, 1, "x")]
    frame = spark.createDataFrame(rows, "k string, text string, page int, pos int, letters string").repartition(7)
    got = {r.key: r for r in best_per_key(frame, "k", "text", "page", "pos").collect()}
    assert len(got) == len({r[0] for r in rows})
    for key, row in got.items():
        own = [r for r in rows if r[0] == key]
        first = min((r[2], r[3]) for r in own)
        known = [(-len(re.sub("[^A-Za-z]", "", r[1])), -len(r[1]), r[2], r[3], r[1]) for r in own if r[1] is not None]
        best = min(known) if known else (None, None, *first, None)
        assert (row.first_page, row.first_pos) == first and row.lines == len(own)
        assert (row.line, row.best_page, row.best_pos) == (best[4], best[2], best[3])
        assert row.letters == (None if best[0] is None else -best[0])
    assert best_per_key(frame.limit(0), "k", "text", "page", "pos").count() == 0
