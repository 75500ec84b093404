"""The stages of the corpus pipeline: each applies one operator's decisions to documents.

Defined results: a null or empty table of documents stays as it is; rows that
are kept keep every column, extra ones and their order included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, minhash, suffix_dedup, toxicity
from .common import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the limit.  The labels teach; they do not decide."""
    lexicon = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(lexicon)(F.col("text")) < toxicity.REJECT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    return decontamination.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each remaining text."""
    from .queries import bpe_digests

    return bpe_digests(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without byte strings that occur twice."""
    return suffix_dedup.without_repeats(docs)
