"""A corpus pipeline over `documents`: each stage works on all rows that the one before it kept.

Defined results: null texts are empty; near duplicates are told apart by id and text, so rows that share an id or have none stay unless they are linked,
and of rows equal in both one stays; rows without words are linked with nothing, and weigh nothing in the mix; rows that share an id are drawn as often as the
one of them that is drawn most; columns with clashing names are kept; an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.bpe_codec import encode_texts
from matchloom.llm.common import checkpointed, table
from matchloom.llm.jaccard_join import one_of_each
from matchloom.llm.quality import keep_good
from matchloom.llm.source_mix import mixed_rows
from matchloom.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates."""
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of words that an earlier document, or an earlier place, has."""
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights draws them."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's BPE ids (decimal, joined by spaces), their number, and digests of ids and decoded text."""
    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), keep=True).drop("decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: The classifier and the codec are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
