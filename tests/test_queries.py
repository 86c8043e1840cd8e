from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from quirekit.plans.check import compare, connect

SF = "/root/testdata/sf0.001"
# One or two queries per family; the check module runs them all.
SAMPLED = [
    "flagship_page_qa", "str_04_modern_punctuation", "str_30_abbreviations", "htm_04_toc_rows", "htm_22_tabular_fragment", "leg_04_heading_levels",
    "cls_07_output_qa", "cls_11_model_routing", "agg_02_progress_summary", "joi_01_add_new_paths", "win_03_page_marker_gaps", "win_05_text_batches",
    "srt_01_merge_order", "set_05_expanded_scopes", "sec_02_redacted_maps", "snk_12_merged_output", "src_10_docx_round_trip", "stm_05_line_buffered_html",
]
# Rewrites without SQL must change some rows and leave others alone.
REWRITES = ["htm_10_sparse_blocks", "htm_11_leading_paragraphs", "htm_15_index", "htm_18_strong_paragraphs", "leg_10_demotions", "leg_01_integrity_contract"]


def test_contract():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert len(queries) > 200 and set(oracles) <= set(queries)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "pages", "passing", "visible_chars"}


@pytest.mark.parametrize("name", SAMPLED)
def test_matches_sql(spark, name):
    line = compare(spark, connect(SF), SF, name)
    assert line.startswith("ok"), line


@pytest.mark.parametrize("name", REWRITES)
def test_rewrites_change_something(spark, name):
    from quirekit.plans.html_queries import doc_html
    from quirekit.plans.legal_queries import legal_html

    before = (legal_html if name.startswith("leg") else doc_html)(spark, SF)
    after = entry_module.queries()[name](spark, SF)
    joined = before.join(after, "doc_id")
    changed = joined.filter("html <> result").count()
    assert 0 < changed and joined.count() == before.count()


def test_scans_are_pruned(spark):
    plan = entry_module.queries()["agg_02_progress_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "text" not in read and "n_chars" in read


def test_row_local_rewrites_do_not_shuffle(spark):
    from pyspark.sql import functions as F

    from quirekit.functions import html, text

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = docs.select("doc_id", html.dedupe_paragraphs(text.modernize_punctuation(F.col("text"))).alias("r"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_headings_are_worked_out_once(spark):
    plan = entry_module.queries()["leg_05_extractors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    once = entry_module.queries()["leg_03_heading_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == once.count("regexp_replace(") > 0
