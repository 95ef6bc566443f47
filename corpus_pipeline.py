"""The corpus pipeline: a list of stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, decontamination, language, quality, simhash
from weft.llm.common import fresh_dir, table, text_of
from weft.llm.entries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a prediction other than `und`, likelier than not."""
    predict = language.predictor(spark, language.trained(docs.filter(language.teaches())))
    found = predict("text")
    return docs.filter((found["lang"] != language.UNDETERMINED) & (found["score"] >= 0.5))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches quality.KEEP."""
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.column(text_of()) >= quality.KEEP)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the round trip's text of each document."""
    return bpe.encoded(docs, vocabulary("word_bpe_49k.json"), ids=True).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [("language", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", encode)]

#: Models and the tokenizer take part in the stages, so SQL can't express the rows; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's documents are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
