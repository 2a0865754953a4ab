"""The corpus pipeline: quality rules, language, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of docs.
Rows with a null id or text pass by the rules of each operator: a null text fails the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resgraph.llm import bpe_automaton, hamming_join, langid, mixing, quality
from resgraph.llm.common import prepare, staged

#: Documents whose language scores less are taken for no language that was learned.
LEAST_LANGUAGE_SCORE = 0.3
POLICY = "v2"


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    prepare(spark)
    found = quality.ledger(docs, name="_quality")
    return found.where(quality.passes(F.col("_quality.fail_bits"), POLICY)).select(*_columns(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the kernel classifier learned from all labelled ones."""
    prepare(spark)
    found = langid.identify(docs, langid.train(docs), name="_language")
    sure = (F.col("_language.lang_pred") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five words, similarity 0.8)."""
    prepare(spark)
    found = hamming_join.near_duplicates(docs, width=5)
    others = found.where("id <> component_id").select(F.col("id").alias("_other")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("_other"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    prepare(spark)
    return mixing.taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of the decoded text."""
    prepare(spark)
    coded = bpe_automaton.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), name="_bpe")
    return coded.select("doc_id", "source", *[F.col(f"_bpe.{c}") for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")])


STAGES = [("quality", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("mix", source_mix), ("tokens", tokens)]
#: SQL can express neither the classifier nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder, so none runs twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
