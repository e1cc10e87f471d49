"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, benchmark leaks, encoding.

Every stage works on all that its predecessor kept. Its result is written as Parquet in the shared folder and read
again, which cuts lineage: a lost executor costs at most the running stage. run() deletes a stage's table once the next
one is written.

Null and empty texts have no words and go with the quality rules. Rows without doc_id are documents of their own; they
come after all others where the least id stays, and before them where the earlier string stays. Of rows that repeat
doc_id and text one stays; different texts of one doc_id are different documents. Of equal documents the least doc_id
stays, so ties leave no choice. Texts of any length are read whole. An empty table gives an empty result with the same
columns. Columns beside those of documents are kept, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import common, decontamination, jaccard_join, quality_rules, sentencepiece_codec, suffix_dedup

TOKENIZER = "piece_bpe_32k.model"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that an earlier document or place holds; emptied documents go."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, verbatim or with other numbers, names and units."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, text as decoded from its ids, with n_tokens and ids."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", rules),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", encoding),
]

#: SQL has neither zstandard nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.drop_table(before)
        before = docs
    return docs
