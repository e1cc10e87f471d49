"""The opN_ queries over whole tables with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


@query
def op6_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from .sentencepiece_codec import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_token_planes(spark, sf_dir):
    import public_tokenizers

    from .token_files import token_round_trip

    return token_round_trip(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), width=4, percent=85)


@query
def op5_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import digests

    return digests(_read(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    from .decontamination import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query
def op2_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query
def op1_quality_model(spark, sf_dir):
    from .quality_model import classify

    return classify(_read(spark, sf_dir, "documents"))


@query
def op8_html_text(spark, sf_dir):
    from .html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


@query
def op9_language_model(spark, sf_dir):
    from .language_model import score

    return score(_read(spark, sf_dir, "documents"))
