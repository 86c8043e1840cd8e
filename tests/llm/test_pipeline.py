"""The pipeline against the brute-force forms of its stages, stage by stage."""

from __future__ import annotations

import re

import corpus_pipeline
import odd
import public_tokenizers
from quirekit.llm import byte_bpe, feistel_pii, toxicity_crf
from test_byte_bpe import check as check_bpe
from test_byte_bpe import library  # noqa: F401
from test_near_copies import parts
from test_spaced_seeds import brute, tokens

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(r) for r in rows)


def test_stages(spark, table, library, tmp_path):  # noqa: F811
    docs, rows = table("documents")
    labels, _ = table("labels")
    _, items = table("benchmark")
    assert [s[0] for s in corpus_pipeline.STAGES][1] == "simhash near-dedup" and len(corpus_pipeline.STAGES) == 5

    def through(i, frame):
        corpus_pipeline.STAGES[i][1](spark, frame, SF).write.parquet(str(tmp_path / str(i)))
        return spark.read.parquet(str(tmp_path / str(i)))

    clean = through(0, docs)
    toxic = {r.doc_id for r in toxicity_crf.predict_documents(docs, labels).where("predicted = 1").collect()}
    rows = [r for r in rows if r.doc_id not in toxic]
    assert clean.columns == docs.columns and plain(clean.collect()) == plain(rows)

    single = through(1, clean)
    # Groups by the 0.8 rule over all pairs; of each the least id stays.
    keep = {min(rows[i].doc_id for i in group) for group in parts([r.text for r in rows])}
    rows = [r for r in rows if r.doc_id in keep]
    assert single.columns == docs.columns and plain(single.collect()) == plain(rows)

    fresh = through(2, single)
    runs = {r.item_id: {tuple(tokens(r.text)[j : j + 3]) for j in range(len(tokens(r.text)) - 2)} for r in items}
    leaks = set()
    for r in rows:
        t = tokens(r.text)
        own = {tuple(t[j : j + 3]) for j in range(len(t) - 2)}
        leaks |= {d for d, _ in brute([(r.doc_id, r.text)], [(i.item_id, i.text) for i in items if len(own & runs[i.item_id]) >= 2])}
    rows = [r for r in rows if r.doc_id not in leaks]
    assert leaks and fresh.columns == docs.columns and plain(fresh.collect()) == plain(rows)

    private = through(3, fresh)
    got = {r.doc_id: r for r in private.collect()}
    assert private.columns == docs.columns and len(got) == len(rows)
    assert all(got[r.doc_id].text == feistel_pii.pseudonymise(r.text, feistel_pii.QUERY_KEY)[0] and got[r.doc_id].n_chars == len(got[r.doc_id].text) for r in rows)

    ids = through(4, private)
    check_bpe(ids, list(got.values()), library)
    assert plain(corpus_pipeline.run(spark, SF).select(ids.columns).collect()) == plain(ids.collect())


def test_odd_rows_through_every_stage(spark):
    for frame in (odd.documents(spark), odd.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, frame, SF)
            assert done.columns == frame.columns and done.dtypes == frame.dtypes and done.count() <= frame.count()
        stage = corpus_pipeline.STAGES[-1][1]
        assert stage(spark, frame, SF).count() == frame.count()


def test_names_are_registered():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and {int(re.match(r"op(\d+)_", q)[1]) for q in queries if re.match(r"op\d+_", q)} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
