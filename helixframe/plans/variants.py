"""Record lines to the nested ``variants`` frame.

All of a record is decoded by column expressions generated from the header.
Typed INFO fields and calls are generated for what is asked for only, so a
narrow query plans narrow expressions.
"""

from __future__ import annotations

import warnings as _warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles, fields, genotypes
from .header import Header

#: What happens to a line that is no record.
MODES = ("failfast", "permissive", "dropmalformed")


def columns_of(line: Column) -> Column:
    """A line's tab-separated columns, trailing white space taken off first."""
    return F.split(F.regexp_replace(line, r"\s+$", ""), "\t")


def expected_columns(header: Header) -> int:
    return 9 + len(header.samples.names) if header.samples.names else 8


def line_error(columns: Column, expected: int) -> Column:
    """Why a line is no record, or null."""
    n = F.size(columns)
    qual = F.get(columns, F.lit(5))
    return (
        F.when(n != expected, F.concat(F.lit("the line has "), n.cast("string"), F.lit(f" columns, not {expected}")))
        .when(F.trim(F.get(columns, F.lit(1))).try_cast("bigint").isNull(), F.lit("POS is no whole number"))
        .when((qual != ".") & fields.number(qual, "Float").isNull(), F.lit("QUAL is no number"))
        .when(F.exists(F.split(F.get(columns, F.lit(4)), ","), lambda a: a == ""), F.lit("ALT holds an empty allele"))
    )


def _warning(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def call_column(header: Header, index: int, format_: Column, columns: Column) -> Column:
    name = header.samples.names[index]
    raw = F.get(columns, F.lit(9 + index))
    parsed = header.samples.is_parsed(name)
    return genotypes.call(F.lit(name), parsed, raw, fields.call_map(format_, raw) if parsed else None)


def calls_column(header: Header, format_: Column, columns: Column) -> Column:
    """All calls in file order: one generic expression over the sample columns, whatever their number."""
    names = header.samples.names
    if not names:
        return F.array().cast("array<struct<sample:string,parsed:boolean,raw:string,data:map<string,string>,gt:string,gt_alleles:array<int>,called:boolean,ploidy:int,ft:array<string>>>")
    zipped = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.slice(columns, 10, len(names)).alias("raw"))
    make = lambda x, f, parsed: genotypes.call(x["name"], parsed, x["raw"], fields.call_map(f, x["raw"]) if parsed else None)
    subset = header.samples.parsed_samples
    one = lambda x, f: make(x, f, True) if not subset else F.when(x["name"].isin(subset), make(x, f, True)).otherwise(make(x, f, False))
    return fields.let(format_, lambda f: F.transform(zipped, lambda x: one(x, f)))


def field_infos(header: Header, kind: str, keys: Sequence[str] | None):
    """Type and cardinality of the fields asked for, of all declared ones by default."""
    if keys is None:
        keys = header.info_ids() if kind == "INFO" else header.format_ids()
    find = header.get_info_field_info if kind == "INFO" else header.get_format_field_info
    with _warnings.catch_warnings():
        _warnings.simplefilter("ignore")
        return {k: find(k) for k in keys}


def parse_records(lines: DataFrame, header: Header, info: Sequence[str] | None = None, checks: Sequence[str] = (), mode: str = "failfast") -> DataFrame:
    """The ``variants`` frame of a frame with a ``value`` column of lines.

    ``path`` and ``line_no`` pass through where present.  Header lines and blank
    lines are dropped.  ``info`` names the typed fields of ``info_t`` (default:
    all declared); ``checks`` may hold ``INFO`` and ``FORMAT`` for list-length
    warnings.  ``mode``: bad lines raise, are kept with ``error`` set and all
    else null, or are dropped.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    from ..operators import check

    kept = [c for c in ("path", "line_no") if c in lines.columns]
    record = ~F.startswith("value", F.lit("#")) & F.col("value").rlike(r"\S")
    body = lines.where(record).withColumn("is_record", record).select(*kept, F.col("value").alias("line"), "is_record")
    body = body.withColumn("c", columns_of(fields.once(F.col("line"))))
    body = body.withColumn("error", F.when(F.col("is_record"), line_error(F.col("c"), expected_columns(header))))  # predicates may be pushed below the filter
    if mode == "failfast":
        body = body.withColumn("c", F.when(F.col("error").isNull(), F.col("c")).otherwise(F.raise_error(F.concat(F.col("error"), F.lit(": "), F.substr("line", F.lit(1), F.lit(200))))))
    elif mode == "dropmalformed":
        body = body.where(F.col("error").isNull())
    else:
        body = body.withColumn("c", F.when(F.col("error").isNull(), F.col("c")))
    at = lambda i: F.get(F.col("c"), F.lit(i))
    format_ = F.split(at(8), ":") if header.samples.names else F.when(F.col("c").isNotNull(), F.array().cast("array<string>"))
    out = body.select(
        *kept,
        "line",
        "c",
        at(0).alias("chrom"),
        F.trim(at(1)).try_cast("bigint").alias("pos"),
        fields.list_or_empty(at(2), ";").alias("id"),
        at(3).alias("ref"),
        alleles.alleles(at(3), at(4)).alias("alt"),
        F.when(at(5) != ".", fields.number(at(5), "Float")).alias("qual"),
        at(5).alias("qual_raw"),
        fields.list_or_empty(at(6), ";").alias("filter"),
        at(7).alias("info_raw"),
        fields.info_map(at(7)).alias("info"),
        format_.alias("format"),
        "error",
    )
    calls = F.when(F.col("c").isNotNull(), calls_column(header, F.col("format"), F.col("c")))
    out = out.withColumn("begin", F.col("pos") - 1).withColumn("calls", calls).withColumn("info_t", info_struct(header, F.col("info"), info))
    out = out.withColumn("warnings", check.warnings_column(header, checks))
    order = [*kept, "chrom", "pos", "begin", "id", "ref", "alt", "qual", "qual_raw", "filter", "info_raw", "info", "info_t", "format", "calls", "warnings", "line"]
    return out.select(*order, *(["error"] if mode == "permissive" else []))


def info_struct(header: Header, info: Column, keys: Sequence[str] | None = None) -> Column:
    """The typed INFO fields as a struct; with none, an empty struct stands as null."""
    infos = field_infos(header, "INFO", keys)
    if not infos:
        return F.lit(None).cast("struct<none:string>")
    return F.struct(*[fields.typed(info, k, f).alias(k) for k, f in infos.items()])


def call_values(header: Header, call: Column, keys: Sequence[str]) -> list[Column]:
    """Typed FORMAT values of one call."""
    return [fields.typed(call["data"], k, f).alias(k) for k, f in field_infos(header, "FORMAT", keys).items()]
