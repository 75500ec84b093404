"""Records back to text.

Texts that were read are written as they were read; only what an operator
changed is made anew, so an unchanged record keeps its numbers' spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles
from ..plans.header import Header


def _or_dot(values: Column, delimiter: str) -> Column:
    joined = F.array_join(values, delimiter)
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def info_text(info: Column, header: Header | None = None) -> Column:
    """INFO: flags as their key, values as ``key=value``."""
    flags = [k for k in header.info_ids() if header.get_info_field_info(k).type == "Flag"] if header else []
    flag = lambda e: e["value"].isNull() | (e["key"].isin(flags) if flags else F.lit(False))
    return _or_dot(F.transform(F.map_entries(info), lambda e: F.when(flag(e), e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")


def call_text(format_: Column, call: Column) -> Column:
    """A call by FORMAT; missing values are dots, an unparsed call is its own text."""
    text = F.array_join(F.transform(format_, lambda k: F.coalesce(F.when(call["data"][k] == "", F.lit(".")).otherwise(F.try_element_at(call["data"], k)), F.lit("."))), ":")
    return F.when(call["parsed"], text).otherwise(call["raw"])


def record_line(header: Header) -> Column:
    """The line of a record for a header; its samples choose and order the calls."""
    parts = [
        F.col("chrom"),
        F.col("pos").cast("string"),
        _or_dot(F.col("id"), ";"),
        F.col("ref"),
        _or_dot(F.transform("alt", alleles.serialize), ","),
        F.coalesce("qual_raw", F.lit(".")),
        _or_dot(F.col("filter"), ";"),
        info_text(F.col("info"), header),
    ]
    if header.samples.names:
        parts.append(_or_dot(F.col("format"), ":"))
        names = F.array(*map(F.lit, header.samples.names))
        ordered = F.transform(names, lambda n: F.try_element_at(F.filter("calls", lambda c: c["sample"] == n), F.lit(-1)))
        same = F.transform("calls", lambda c: c["sample"]) == names
        parts.append(F.array_join(F.transform(F.when(same, F.col("calls")).otherwise(ordered), lambda c: call_text(F.col("format"), c)), "\t"))
    return F.concat_ws("\t", *parts)


def render_lines(variants: DataFrame, header: Header) -> DataFrame:
    """A ``value`` column of lines; ``path`` and ``line_no`` pass through."""
    kept = [c for c in ("path", "line_no", "chrom", "pos") if c in variants.columns]
    return variants.select(*kept, record_line(header).alias("value"))
