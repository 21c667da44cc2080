"""Corpus pipeline over the operators of ``tesserae.llm``: quality, exact and near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, near_jaccard, packing, pii, quality_model
from tesserae.llm.common import staged, stored, table

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant, trained on ``labels``, doesn't reject; a null text counts as empty, every row is judged by its own text."""
    return quality_model.drop_rejected(docs, table(spark, sf_dir, "labels"))


@staged
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest, then the one with the smallest id, then the first row. A null text counts as empty, and all empty texts are equal; an id that is null comes last."""
    return exact_dedup.drop_exact(docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a Jaccard similarity of 0.8 or more over five-word shingles join, the one with the smallest id (null ids last, then the first row). Texts without words are alike.

    SimHash fingerprints within three bits, as in ``op9`` but over five words, are the first candidates; MinHash bands give those that three bits don't reach. Texts decide on both.
    """
    return near_jaccard.drop_near(docs, width=5)


@staged
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars counts the masked text. Null texts stay null; all other columns keep their values."""
    masked = pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids; a null or empty text is the end token alone, repeated rows are packed each."""
    return packing.pack(docs, TOKENIZER_FILE, public_tokenizers.PATTERN).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packed", packed)]

#: A token of the byte-level BPE can't be had in SQL; tests compare :func:`run` with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
