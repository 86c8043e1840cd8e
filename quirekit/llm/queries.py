"""The registered queries of the operators in this folder, with SQL where SQL can state them."""

from __future__ import annotations

from quirekit.llm import (
    byte_bpe,
    cross_align,
    feistel_pii,
    license_scan,
    main_content,
    minhash_oph,
    ranked_search,
    repetition_rules,
    simhash_pivots,
    slot_shards,
    spaced_seeds,
    toxicity_crf,
    vbyte_ids,
)
from quirekit.sources.tables import read_table

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op3_one_permutation_minhash")
def op3(spark, sf_dir):
    return minhash_oph.compare_with_next(read_table(spark, sf_dir, "documents"))


@query("op9_simhash_pivot_tables")
def op9(spark, sf_dir):
    return simhash_pivots.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op10_virtual_slots")
def op10(spark, sf_dir):
    return slot_shards.shard_documents(read_table(spark, sf_dir, "documents"))


@query("op5_license_dice", license_scan.oracle())
def op5(spark, sf_dir):
    return license_scan.scan_documents(read_table(spark, sf_dir, "documents"))


@query("op6_main_content")
def op6(spark, sf_dir):
    return main_content.extract_pages(read_table(spark, sf_dir, "pages"))


@query("op2_spaced_seeds")
def op2(spark, sf_dir):
    return spaced_seeds.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op7_feistel_pseudonyms")
def op7(spark, sf_dir):
    return feistel_pii.digests(read_table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    import public_tokenizers

    return byte_bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_stream_vbyte")
def op8(spark, sf_dir):
    import public_tokenizers

    return vbyte_ids.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_crf_toxicity")
def op1(spark, sf_dir):
    return toxicity_crf.predict_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op11_repetition_coverage", repetition_rules.oracle())
def op11(spark, sf_dir):
    return repetition_rules.judge_documents(read_table(spark, sf_dir, "documents"))


@query("op12_identity_map_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    return cross_align.align_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_accumulator_limited_search", ranked_search.oracle())
def op13(spark, sf_dir):
    return ranked_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
