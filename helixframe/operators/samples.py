"""Samples: subsets, order, long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.header import Header, SamplesInfos


def call_for_sample(calls: Column, name: str) -> Column:
    """A sample's call; of repeated names the last."""
    return F.try_element_at(F.filter(calls, lambda c: c["sample"] == name), F.lit(-1))


def select_samples(variants: DataFrame, header: Header, names: Sequence[str]) -> tuple[DataFrame, Header]:
    """Calls of the named samples in the order named, and the header to match."""
    missing = [n for n in names if n not in header.samples.names]
    if missing:
        raise KeyError(f"no sample {', '.join(missing)}")
    calls = F.array(*[call_for_sample(F.col("calls"), n) for n in names])
    return variants.withColumn("calls", calls), Header(header.lines, SamplesInfos(list(names)))


def explode_alleles(variants: DataFrame, *keep: str) -> DataFrame:
    """One row for each alternative allele, as ``allele``.

    Outer, and the nulls dropped after: of a plain ``explode`` the optimizer
    infers filters on the array, which would work it out three times over.
    """
    return variants.select(*keep, F.explode_outer("alt").alias("allele")).where(F.col("allele").isNotNull())


def explode_calls(variants: DataFrame, *keep: str) -> DataFrame:
    """One row for each call, as ``sample_no`` and ``call``."""
    return variants.select(*keep, F.posexplode_outer("calls").alias("sample_no", "call")).where(F.col("call").isNotNull())


def calls_long(variants: DataFrame, header: Header, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each record and sample, with typed FORMAT values."""
    from ..plans.variants import call_values

    long = explode_calls(variants, "chrom", "pos", "ref", "alt")
    return long.select("chrom", "pos", "ref", "alt", "sample_no", "call.sample", "call.gt", "call.gt_alleles", "call.called", "call.ploidy", *call_values(header, F.col("call"), keys))
