"""From raw documents to training tokens: language, exact copies, near copies, mixture, tokens."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marksheet.llm import bpe, exact, langid, mix, near
from marksheet.llm.common import Scratch, documents, small_batches
from marksheet.llm.queries import bpe_digests


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go.

    Without any label to learn from, every text with a letter stays.  Null ids, repeated rows, long texts and
    further columns are kept as they are; an empty table stays empty.
    """
    small_batches(spark)
    return langid.with_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z in lower case) the one with the largest id; of repeated rows one.

    Null and empty texts are equal.  A null id stays only where no other has the text; an empty table stays empty.
    """
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (three words) are linked by two bits or fewer.

    It is the one with the smallest id; of repeated rows one stays.  Texts without a word are one group, a null
    id stays only in a group without another, and an empty table stays empty.
    """
    small_batches(spark)
    return near.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: a document taken twice is two rows, others go.

    Null sources are one source, null texts have no words, repeated rows are taken like any other, and an
    empty table stays empty.
    """
    return mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, number of tokens and digests of every row, repeated ones too; null texts have no token."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_digests(bpe.encode(docs, *ranks), ranks[0])


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None       # languages and fingerprints are not SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written, read by the next, and then deleted."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage_{name}")
        scratch.only(docs)
    return docs
