"""One query for each corpus operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resgraph.llm import bitplane, bpe_automaton, gru_lm, hamming_join, hnsw, langid, mixing, quality, token_counts, url_rules
from resgraph.llm.common import prepare, table


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.mine(url_rules.labelled(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, rules).withColumnRenamed("id", "page_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = hnsw.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_automaton.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)
    return coded.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op6_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bitplane.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bits = F.col("quality.fail_bits")
    measures = [F.col(f"quality.{m}") for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *measures, (~quality.passes(bits, "v1")).alias("base_failed"), quality.passes(bits, "v2").alias("kept"), bits.alias("fail_bits"))


def op8_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = hamming_join.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return gru_lm.scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


QUERIES = {
    "op1_url_rules": op1_url_rules,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_hnsw": op4_hnsw,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_bitplane": op6_bitplane,
    "op7_quality_ledger": op7_quality_ledger,
    "op8_hamming_join": op8_hamming_join,
    "op9_gru_lm": op9_gru_lm,
    "op10_langid": op10_langid,
}

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS r(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS o(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
f AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * (n_upper + n_lower) THEN 64 ELSE 0 END AS bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, bits & 3 <> 0 AS base_failed,
       bits = 0 AS kept, bits::BIGINT AS fail_bits
FROM f
"""

SQL = {"op7_quality_ledger": OP7_SQL}
