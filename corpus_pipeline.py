"""The corpus pipeline: stages over ``documents``, each applying one operator of ``quirekit.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; ``run`` writes each result as
Parquet into the shared folder and reads it back, so a stage starts from files and no lineage grows across stages. The
near-duplicate stage keeps the least ``doc_id`` of each component; of several rows with that id, one row by content.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm import byte_bpe, feistel_pii, near_copies, spaced_seeds, toxicity_crf
from quirekit.session import ensure_checkpoint_dir
from quirekit.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not predict as toxic."""
    return toxicity_crf.clean_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 0.8 or more of the 5-word shingles shared."""
    return near_copies.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return spaced_seeds.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the new text."""
    done = feistel_pii.pseudonymise_documents(docs).drop("pii")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("pii", pseudonymise),
    ("byte-level bpe", encode),
]
#: Learned weights and byte-pair merges have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
