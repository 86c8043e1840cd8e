from __future__ import annotations

import re

from quirekit.llm import license_scan as lic


def brute(text):
    """Every segment against every template."""
    text = text or ""
    pieces = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p.strip()]
    found = []
    for piece in pieces:
        own = set(lic.bigrams_of(piece))
        scored = [(2 * len(own & set(lic.bigrams_of(t))) / (len(own) + len(lic.bigrams_of(t))), -i, name) for i, (name, t) in enumerate(lic.templates()) if own]
        if scored and max(scored)[0] >= lic.THRESHOLD:
            found.append(max(scored))
    found.sort(reverse=True)
    return len(found), ",".join(sorted({n for *_, n in found})), found[0][2] if found else None, round(found[0][0], 6) if found else None


def check(frame, rows):
    got = sorted(str((r.doc_id, r.n_matches, r.licences, r.best_licence, r.best_dice)) for r in frame.collect())
    assert got == sorted(str((r.doc_id, *brute(r.text))) for r in rows)
    return got


def test_stored_rows(table):
    docs, rows = table("documents")
    assert any("None" not in g for g in check(lic.scan_documents(docs), rows))


def test_wordings(spark):
    mit = dict((n, t) for n, t in lic.templates() if t.startswith("Permission is hereby"))["MIT"]
    texts = [
        "licensed under CC-BY 4.0", "LICENSED UNDER THE APACHE LICENSE VERSION 2", "spdx license identifier gpl 3.0 or later", mit,
        "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70)), mit.replace("Software", "Library"), "a text about a license for a dog",
        "Some prose.\n\nReleased under the MIT License.\n\nMore prose.\nThis work is licensed under the GNU General Public License, version 3.", mit[: len(mit) // 2],
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(lic.scan_documents(frame), frame.collect())
    best = {r.doc_id: r.best_licence for r in lic.scan_documents(frame).collect()}
    assert [best[i] for i in range(9)] == ["CC-BY-4.0", "Apache-2.0", "GPL-3.0-or-later", "MIT", best[4], "MIT", None, "GPL-3.0", None]


def test_odd_rows(docs, no_docs):
    check(lic.scan_documents(docs), docs.collect())
    assert lic.scan_documents(no_docs).count() == 0


def test_no_match_lacks_a_marker():
    """Templates with every third bigram taken away still hold a marker."""
    for bigrams in lic._BIGRAMS:
        bare = [b for b in bigrams if not set(b.split()) & set(lic.MARKERS)]
        assert len(bare) < lic.reach(len(bigrams))[0] or lic.reach(len(bigrams))[0] == 0


def test_plan_is_native(docs):
    plan = lic.scan_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
