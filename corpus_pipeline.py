"""A training-data pipeline: documents through the stages in order, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricetrail.llm import line_rules, mixing, near_copies, pieces, subword
from pricetrail.llm.queries import quality_model
from pricetrail.session import ensure_checkpoint_dir, workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Documents that score below are rejected by the classifier stage.
MIN_QUALITY = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels below ``sf_dir``, doesn't reject."""
    scored = subword.quality_scores(docs.select(*COLUMNS), quality_model(spark, sf_dir), COLUMNS)
    return scored.where(scored["score"] >= MIN_QUALITY).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of a source share."""
    return line_rules.cleaned(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles stays: the one with the smallest doc_id."""
    return near_copies.first_of_each_group(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether they decode to its text."""
    return pieces.encoded_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "lang", "source"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify), ("quality_rules", rules), ("near_dedup", near_dedup),
    ("mix_sources", mix), ("encode_pieces", encode),
]

#: The stages learn, hash and encode in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents below ``sf_dir``; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
