"""The corpus pipeline: training-data operators, one after the other, over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``docs``; each works on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import stages
from helixframe.llm.common import discard, read_table, stored

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.drop_near_copies),
    ("suffix_array_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.drop_leaks),
    ("bpe", stages.encode),
]

#: The fitted score and the hash-named sets of the stages are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it, and deleted after."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
