"""A pipeline over ``documents``: each stage is one of the corpus operators.

Documents that the classifier rejects go, one of each group of near duplicates stays, strings that still
repeat are cut out, personal data is replaced, and the rest is packed into token windows. Every stage is
written as Parquet to the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecensus.llm import jaccard, packing, pii, quality, suffixes
from pagecensus.llm.common import load, prepare, stage


# Passages of over 50 words must not repeat.
PASSAGE_WORDS = 51


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with the length of their text after a stage changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not, by their text and their site."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at 80 percent."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes, or passages of 51 words of any length, that stand anywhere else too.

    51 words are 101 bytes at least and mostly below 400, so they are counted as words, not as bytes: cutting
    all repeats of 101 bytes would take shorter passages as well.
    """
    prepare(spark)
    return _counted(suffixes.without_repeats(docs, min_words=PASSAGE_WORDS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    prepare(spark)
    return _counted(pii.with_surrogates(docs, pii.key_of(spark)).drop("_entities"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", reject_bad),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("personal_data", replace_personal_data),
    ("packing", pack_tokens),
]

# Models, surrogates and packing are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
