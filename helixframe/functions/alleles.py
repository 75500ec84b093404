"""Alternative alleles: classification, breakends, and what follows for a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import let

SNV, MNV, DEL, INS, INDEL, SV, BND, SYMBOLIC, MIXED = "SNV", "MNV", "DEL", "INS", "INDEL", "SV", "BND", "SYMBOLIC", "MIXED"
#: Directions of a breakend and its mate, and the ends of a strand.
FORWARD, REVERSE = "+", "-"
FIVE_PRIME, THREE_PRIME = "5", "3"


def substitution_type(ref: Column, alt: Column) -> Column:
    same_start = F.left(ref, F.lit(1)) == F.left(alt, F.lit(1))
    a, b = F.length(ref), F.length(alt)
    return (
        F.when(a == b, F.when(a == 1, F.lit(SNV)).otherwise(F.lit(MNV)))
        .when(a > b, F.when((b == 1) & same_start, F.lit(DEL)).otherwise(F.lit(INDEL)))
        .otherwise(F.when((a == 1) & same_start, F.lit(INS)).otherwise(F.lit(INDEL)))
    )


def _allele(raw: Column, kind: str, type_: Column, **parts: Column) -> Column:
    kinds = {"value": "string", "mate_chrom": "string", "mate_pos": "bigint", "orientation": "string", "mate_orientation": "string", "sequence": "string", "within_main_assembly": "boolean"}
    rest = [parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return F.struct(raw.alias("raw"), F.lit(kind).alias("kind"), type_.alias("type"), *rest)


def _breakend(alt: Column, parts: Column) -> Column:
    """A breakend from its text and that text split at the brackets."""
    mate = F.get(parts, F.lit(1))
    ancillary = F.startswith(mate, F.lit("<"))
    forward = F.left(alt, F.lit(1)).isin("[", "]")
    chrom = F.substring_index(mate, ":", 1)
    return _allele(
        alt,
        "breakend",
        F.lit(BND),
        mate_chrom=F.when(ancillary, F.substr(chrom, F.lit(2), F.length(chrom) - 2)).otherwise(chrom),
        mate_pos=F.substr(mate, F.instr(mate, ":") + 1).try_cast("bigint"),
        orientation=F.when(forward, "+").otherwise("-"),
        mate_orientation=F.when(F.contains(alt, F.lit("[")), "+").otherwise("-"),
        sequence=F.when(forward, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0))),
        within_main_assembly=~ancillary,
    )


def allele(ref: Column, alt: Column) -> Column:
    """One alternative allele as a struct; ``kind`` tells its class, ``type`` its type code.

    Plain substitutions, by far the most, take substring tests only.
    """
    forward, reverse = F.startswith(alt, F.lit(".")), F.endswith(alt, F.lit("."))
    symbolic = F.startswith(alt, F.lit("<")) & F.endswith(alt, F.lit(">"))
    return (
        F.when(F.contains(alt, F.lit("[")) | F.contains(alt, F.lit("]")), let(F.split(alt, r"[\[\]]"), lambda p: _breakend(alt, p)))
        .when(forward, _allele(alt, "single_breakend", F.lit(BND), orientation=F.lit("+"), sequence=F.substr(alt, F.lit(2))))
        .when(reverse, _allele(alt, "single_breakend", F.lit(BND), orientation=F.lit("-"), sequence=F.left(alt, F.length(alt) - 1)))
        .when(symbolic, _allele(alt, "symbolic", F.lit(SYMBOLIC), value=F.substr(alt, F.lit(2), F.length(alt) - 2)))
        .otherwise(_allele(alt, "substitution", substitution_type(ref, alt), value=alt))
    )


def alleles(ref: Column, alt: Column) -> Column:
    """The alternative alleles of an ALT field; a dot is none."""
    parts = let(alt, lambda a: F.when(a == ".", F.array().cast("array<string>")).otherwise(F.split(a, ",")))
    return let(ref, lambda r: F.transform(parts, lambda a: allele(r, a)))


def serialize(a: Column) -> Column:
    """An allele's text from its parts."""
    chrom = F.when(a["within_main_assembly"], a["mate_chrom"]).otherwise(F.concat(F.lit("<"), a["mate_chrom"], F.lit(">")))
    place = F.concat(chrom, F.lit(":"), a["mate_pos"].cast("string"))
    tag = F.when(a["mate_chrom"].isNull(), F.lit(".")).when(a["mate_orientation"] == "+", F.concat(F.lit("["), place, F.lit("["))).otherwise(F.concat(F.lit("]"), place, F.lit("]")))
    breakend = F.when(a["orientation"] == "+", F.concat(tag, a["sequence"])).otherwise(F.concat(a["sequence"], tag))
    return F.when(a["kind"].isin("breakend", "single_breakend"), breakend).when(a["kind"] == "symbolic", F.concat(F.lit("<"), a["value"], F.lit(">"))).otherwise(a["value"])


def is_snv(ref: Column, alt: Column) -> Column:
    """Whether all alleles change one base for another; true without alleles."""
    return (F.length(ref) == 1) & F.forall(alt, lambda a: a["type"] == SNV)


def _only_insertions(alt: Column) -> Column:
    return (F.size(alt) > 0) & F.forall(alt, lambda a: a["type"] == INS)


def affected_start(pos: Column, alt: Column) -> Column:
    """First affected place, from 0: insertions affect the gap after the base at ``pos``."""
    return F.when(_only_insertions(alt), pos).otherwise(pos - 1)


def affected_end(pos: Column, ref: Column, alt: Column) -> Column:
    """One past the last affected place."""
    return F.when(_only_insertions(alt), pos).otherwise(pos - 1 + F.length(ref))
