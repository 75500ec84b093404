"""Region queries: 1-based, both ends included; ends follow from REF alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from .names import unused

#: Places of the widest regions that are joined by bin.
WIDE = 1 << 24


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """``chrom``, ``chrom:start`` (to the end) or ``chrom:start-end``; commas in numbers are dropped."""
    chrom, colon, rest = text.partition(":")
    if not colon:
        return text, None, None
    start, dash, end = rest.replace(",", "").partition("-")
    return chrom, int(start), int(end) if dash else None


def resolve(region: str | None = None, chrom: str | None = None, start: int | None = None, end: int | None = None) -> tuple[str, int | None, int | None]:
    """A region from text or from parts, not from both."""
    if region is not None:
        if chrom is not None or start is not None or end is not None:
            raise ValueError("give a region or a chromosome with start and end, not both")
        return parse_region(region)
    if chrom is None:
        raise ValueError("start and end need a chromosome")
    return chrom, start, end


def overlaps(chrom: str, start: int | None = None, end: int | None = None) -> Column:
    out = F.col("chrom") == chrom
    if end is not None:
        out = out & (F.col("pos") <= end)
    if start is not None:
        out = out & (F.col("pos") + F.length("ref") - 1 >= start)
    return out


def fetch(variants: DataFrame, region: str | None = None, chrom: str | None = None, start: int | None = None, end: int | None = None, contigs: list[str] | None = None) -> DataFrame:
    """Records that overlap a region; an unknown sequence is an error where the known ones are given."""
    c, s, e = resolve(region, chrom, start, end)
    if contigs is not None and c not in contigs:
        raise ValueError(f"unknown sequence {c}")
    return variants.where(overlaps(c, s, e))


def fetch_many(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Records by many regions at once: ``region_id`` and the records' columns.

    ``regions``: ``region_id, chrom, start, end``, 1-based and with both ends; a
    null start is the first place, a null end the last, so with neither it is
    the whole sequence.  Regions of up to ``WIDE`` places are an equi-join on
    chromosome and bin, then the exact test: a record is filed under one bin and
    a region names all bins that may overlap it, so no pair occurs twice.  Wider
    ones would name thousands of bins to get most of a chromosome; they join on
    the chromosome alone.  Skewed bins and chromosomes are split by the adaptive join.
    """
    c, start, end, key, place, id_ = (unused(n, variants) for n in ("region_chrom", "region_start", "region_end", "region_key", "filed", "region_id"))
    asked = regions.select(F.col("region_id").alias(id_), F.col("chrom").alias(c), F.coalesce(F.col("start").cast("bigint"), F.lit(1)).alias(start), F.col("end").cast("bigint").alias(end))
    narrow = F.coalesce(F.col(end) - F.col(start) < WIDE, F.lit(False))
    near = (F.col("chrom") == F.col(c)) & (F.col(end).isNull() | (F.col("pos") <= F.col(end))) & (F.col("pos") + F.length("ref") - 1 >= F.col(start))
    kept = [id_, *variants.columns]
    out = []
    few = asked.where(narrow)
    if not few.isEmpty():
        begin = F.greatest(F.col(start) - 1, F.lit(0)).cast("bigint")
        few = few.withColumn(key, F.explode(bins.region_bins_column(begin, F.greatest(F.col(end), begin + 1))))
        filed = variants.withColumn(place, bins.finest_bin(F.col("pos") - 1, F.col("pos") - 1 + F.greatest(F.length("ref"), F.lit(1))))
        out.append(filed.join(few, near & (F.col(place) == F.col(key))).select(*kept))
    many = asked.where(~narrow)
    if not many.isEmpty() or not out:
        out.append(variants.join(many, near).select(*kept))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
