"""Queries opN_<name> over the driver's tables, each through its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this box."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import stored
    from weft.llm.html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"), stored)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.fingerprints import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.licenses import scanned

    return scanned(table(spark, sf_dir, "documents")).select("doc_id", "license", "containment")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.language import languages

    return languages(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.simhash import linked

    return linked(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.token_files import read_token_files, token_files

    return read_token_files(spark, token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe_round_trip, op3_html_text, op4_fingerprints, op5_decontamination, op6_licenses, op7_language, op8_simhash, op9_token_files, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    """SQL twins, where SQL can express the rows: models, tokenizers and XXH64 are beyond it."""
    from weft.llm.licenses import oracle

    return {"op6_licenses": oracle()}
