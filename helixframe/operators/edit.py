"""Annotation of records: filters, formats, genotypes, INFO and call values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, genotypes
from .names import unused


def with_filter(filters: Column, label: Column) -> Column:
    """A filter list with a label: unchanged if it is there; ``PASS`` goes when it is added."""
    return F.when(F.array_contains(filters, label), filters).otherwise(F.array_append(F.array_remove(filters, "PASS"), label))


def add_filter(variants: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """Mark records, those where a condition holds or all."""
    new = with_filter(F.col("filter"), F.lit(label))
    return variants.withColumn("filter", new if where is None else F.when(F.coalesce(where, F.lit(False)), new).otherwise(F.col("filter")))


def _rebuilt(c: Column, data: Column) -> Column:
    """A parsed call with other data; genotype and filters follow."""
    fresh = genotypes.call(c["sample"], True, c["raw"], data)
    # A genotype set by hand as a dot is one missing allele.
    return F.when(c["parsed"], fresh).otherwise(c)


def add_format(variants: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Append a FORMAT key if it is not there, with a value for parsed calls that have none.

    Unparsed calls stay as they are, with a warning in the record.
    """
    absent = ~F.array_contains("format", key)
    out = variants
    if value is not None:
        add = lambda c: _rebuilt(c, F.when(F.map_contains_key(c["data"], key), c["data"]).otherwise(F.map_concat(c["data"], F.create_map(F.lit(key), F.lit(value)))))
        unparsed = F.transform(
            F.filter("calls", lambda c: ~c["parsed"]),
            lambda c: F.struct(F.lit("CannotModifyUnparsedCallWarning").alias("code"), F.concat(F.lit("the call of "), c["sample"], F.lit(" was not parsed and is not changed")).alias("message")),
        )
        out = out.withColumn("warnings", F.when(absent, F.concat("warnings", unparsed)).otherwise(F.col("warnings")))
        out = out.withColumn("calls", F.when(absent, F.transform("calls", add)).otherwise(F.col("calls")))
    return out.withColumn("format", F.when(absent, F.array_append("format", F.lit(key))).otherwise(F.col("format")))


def _put(map_: Column, key: Column, value: Column) -> Column:
    """A map with one entry set, in place if the key is there."""
    set_ = F.transform_values(map_, lambda k, v: F.when(k == key, value).otherwise(v))
    return F.when(F.map_contains_key(map_, key), set_).otherwise(F.map_concat(map_, F.map_from_arrays(F.array(key), F.array(value))))


def set_info(variants: DataFrame, key: str, value: Column | None) -> DataFrame:
    """Set an INFO value (a string, number or array column; null: a dot), or a flag with None."""
    text = F.lit(None).cast("string") if value is None else _text(variants, value, fields.escape_info)
    # Bound to a column first: vectorised functions do not run inside lambdas.
    name = unused("text", variants)
    out = variants.withColumn(name, text)
    return out.withColumn("info", _put(F.col("info"), F.lit(key), F.col(name))).drop(name)


def drop_info(variants: DataFrame, key: str) -> DataFrame:
    return variants.withColumn("info", F.map_filter("info", lambda k, v: k != key))


def set_call_value(variants: DataFrame, key: str, value: Column, sample: str | None = None) -> DataFrame:
    """Set a FORMAT value of parsed calls, of one sample or all; ``FORMAT`` is extended if need be."""
    name = unused("text", variants)
    out = add_format(variants, key).withColumn(name, _text(variants, value, fields.escape_format))
    change = lambda c: _rebuilt(c, _put(c["data"], F.lit(key), F.col(name)))
    pick = change if sample is None else lambda c: F.when(c["sample"] == sample, change(c)).otherwise(c)
    return out.withColumn("calls", F.transform("calls", pick)).drop(name)


def set_genotype(variants: DataFrame, genotype: Column, sample: str | None = None) -> DataFrame:
    """Set GT; alleles, phase and ploidy follow."""
    return set_call_value(variants, "GT", genotype, sample)


def update_calls(variants: DataFrame, calls: Column) -> DataFrame:
    """Replace the calls."""
    return variants.withColumn("calls", calls)


def _text(variants: DataFrame, value: Column, escape) -> Column:
    from pyspark.sql import types as T

    kind = variants.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, T.ArrayType):
        texts = float_texts(value) if isinstance(kind.elementType, T.DoubleType) else value.cast("array<string>")
        parts = F.transform(texts, escape)
        return F.when(F.size(value) == 0, F.lit(".")).otherwise(F.array_join(parts, ","))
    return escape(float_text(value) if isinstance(kind, T.DoubleType) else value.cast("string"))


def float_text(value: Column) -> Column:
    """Shortest decimal text as Python prints it; a vectorised function, used for changed floats only."""
    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v != v else repr(float(v)), na_action="ignore")

    return text(value)


def float_texts(values: Column) -> Column:
    """The same for arrays."""

    @F.pandas_udf("array<string>")
    def texts(x: pd.Series) -> pd.Series:
        return x.map(lambda vs: None if vs is None else [None if v is None or v != v else repr(float(v)) for v in vs])

    return texts(values)


def soft_filter_total_depth(variants: DataFrame, least: int, label: str, key: str = "DP") -> DataFrame:
    """Mark records whose calls' depths add up to less than a limit."""
    depth = F.aggregate("calls", F.lit(0).cast("bigint"), lambda acc, c: acc + F.coalesce(fields.number(F.try_element_at(c["data"], F.lit(key)), "Integer"), F.lit(0).cast("bigint")))
    return add_filter(variants, label, depth < least)
