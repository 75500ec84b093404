"""Genotypes: what follows from a call's GT and FT texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import let

HOM_REF, HET, HOM_ALT = 0, 1, 2


def gt_alleles(gt: Column) -> Column:
    """Allele numbers, null for a dot; null without genotype."""
    return F.transform(F.split(gt, "[|/]"), lambda e: F.nullif(e, F.lit(".")).try_cast("int"))


def called(alleles: Column) -> Column:
    return F.forall(alleles, lambda a: a.isNotNull())


def ploidy(alleles: Column) -> Column:
    return F.when(alleles.isNotNull(), F.size(alleles))


def is_phased(gt: Column) -> Column:
    return F.contains(F.coalesce(gt, F.lit("")), F.lit("|"))


def gt_phase_char(gt: Column) -> Column:
    return F.when(is_phased(gt), F.lit("|")).otherwise(F.lit("/"))


def gt_bases(ref: Column, alt: Column, alleles: Column) -> Column:
    """Bases of each allele number; breakends have none."""
    return F.transform(alleles, lambda a: F.when(a == 0, ref).when(a > 0, F.get(alt, a - 1)["value"]))


def gt_type(alleles: Column) -> Column:
    """0 homozygous reference, 1 heterozygous, 2 homozygous alternative; null if not called."""
    kind = F.when(F.forall(alleles, lambda a: a == 0), HOM_REF).when(F.size(F.array_distinct(alleles)) == 1, HOM_ALT).otherwise(HET)
    return F.when(F.coalesce(called(alleles), F.lit(False)), kind)


def is_het(alleles: Column) -> Column:
    return F.coalesce(gt_type(alleles) == HET, F.lit(False))


def is_variant(alleles: Column) -> Column:
    return F.coalesce(gt_type(alleles) > HOM_REF, F.lit(False))


def is_filtered(ft: Column, require: Sequence[str] = (), ignore: Sequence[str] = ()) -> Column:
    """Whether any filter counts: not ignored (``PASS`` is, by default) and, if some are required, one of them."""
    ignored = list(ignore) or ["PASS"]
    counts = lambda f: ~f.isin(ignored) & (f.isin(list(require)) if require else F.lit(True))
    return F.coalesce(F.exists(ft, counts), F.lit(False))


def call(sample: Column, parsed: bool, raw: Column, data: Column | None) -> Column:
    """The call struct; an unparsed one keeps its text only."""

    def struct(data: Column, gt: Column, al: Column, ft: Column) -> Column:
        return F.struct(
            sample.alias("sample"), F.lit(parsed).alias("parsed"), raw.alias("raw"), data.alias("data"), gt.alias("gt"), al.alias("gt_alleles"),
            called(al).alias("called"), ploidy(al).alias("ploidy"), ft.alias("ft"),
        )

    if not parsed:
        return struct(*(F.lit(None).cast(k) for k in ("map<string,string>", "string", "array<int>", "array<string>")))

    def with_data(d: Column) -> Column:
        ft = F.filter(F.split(F.try_element_at(d, F.lit("FT")), ";"), lambda x: x != ".")
        gt = F.nullif(F.try_element_at(d, F.lit("GT")), F.lit("."))
        return let(gt, lambda g: let(gt_alleles(g), lambda al: struct(d, g, al, ft)))

    return let(data, with_data)
