"""Queries over the driver's tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, fingerprint, htmltext, infill, ordinal, packing, quality_rules, quotes, secrets, setjoin, urlfilter, warc
from .common import table


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.classes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.ordered(table(spark, sf_dir, "conversations"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(table(spark, sf_dir, "documents"))


def op12_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_document_fingerprints, op2_warc_zstd, op3_quality_classifier, op4_ngram_jaccard_join, op5_quality_rules,
        op6_quotation_linking, op7_html_extraction, op8_power_of_two_packing, op9_secret_scans, op10_bpe_chunk_reuse, op11_phrase_collocations, op12_url_filter_cascade, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_zstd": warc.SQL, "op5_quality_rules": quality_rules.SQL, "op11_phrase_collocations": collocations.SQL,
        "op12_url_filter_cascade": urlfilter.SQL, "op13_fill_in_middle": infill.SQL}
