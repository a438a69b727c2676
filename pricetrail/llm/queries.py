"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricetrail.llm import hilbert, lattice_lm, line_rules, mixing, pieces, repair, simhash, substrings, subword, token_counts, toxicity, url_rules, whitening
from pricetrail.llm.frames import held_out, table


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_encode_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def quality_model(spark: SparkSession, folder: str) -> subword.Model:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return subword.fitted(subword.labelled_sample(docs, labels, "quality", ~held_out("doc_id", 4, 2), subword.SAMPLE))


def op4_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = subword.quality_scores(table(spark, folder, "documents"), quality_model(spark, folder))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_rules.RULES), "host string, path string, verdict string")
    return url_rules.filter_urls(table(spark, folder, "pages"), rules)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.toxicity_scores(docs, labels, ~held_out("doc_id", 3, 1))
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "evidence"
    )


def op8_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = held_out("doc_id", 7, 2)
    scored = lattice_lm.score_documents(table(spark, folder, "documents"), ~out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept"
    )


def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents"))


def op12_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


def op13_repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damaged_and_repaired(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_encode_pieces": op2_encode_pieces,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_quality_scores": op4_quality_scores,
    "op5_url_rules": op5_url_rules,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity_scores": op7_toxicity_scores,
    "op8_lattice_scores": op8_lattice_scores,
    "op9_line_rules": op9_line_rules,
    "op10_simhash_groups": op10_simhash_groups,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_whitened_embeddings": op12_whitened_embeddings,
    "op13_repaired_conversations": op13_repaired_conversations,
}

ORACLE: dict[str, str] = {"op5_url_rules": url_rules.ORACLE, "op9_line_rules": line_rules.ORACLE, "op11_substring_dedup": substrings.ORACLE}
