"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, mixing, sentencepiece_bpe, simhash, suffix
from .common import table
from .queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws stay; texts that are null, empty or without words go, as they have no evidence."""
    return importance.resample(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, of texts whose five-word shingles have a Jaccard similarity of 0.8 at least.

    Candidates come from SimHash fingerprints in balls. Texts without words are each other's copies; rows are told apart by
    id and text, so rows without ids stay if their texts do.
    """
    return simhash.keep_one(docs.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document, or earlier in the same one, are cut out; n_chars follows.

    Documents that nothing is left of go; null texts stay null, with a null n_chars.
    """
    cleaned = suffix.remove_repeats(docs.select(COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their number of copies, in the mixture's order; documents without a source are a source of their own."""
    mixed = mixing.poisson_mix(docs.select(COLUMNS), mixing.source_rates(docs))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, and digests of its ids and of what they decode to; null texts have no tokens."""
    return sentencepiece_bpe.encode_digests(docs, tokenizer_file("piece_bpe_32k.model"))
