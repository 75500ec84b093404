"""Record checks, reported as data in the ``warnings`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.bins import binomial
from ..plans.header import FieldInfo, Header

_NONE = "array<struct<code:string,message:string>>"


def unknown_filters(filters: Column, header: Header) -> Column:
    """Filters that the header does not declare; ``PASS`` is always known."""
    return F.array_except(filters, F.array(*[F.lit(x) for x in {"PASS": 1, **dict.fromkeys(header.filter_ids())}]))


def _genotypes(n_alt: Column, strict: bool) -> Column:
    """Genotypes of a diploid call; ``strict`` counts pairs of the listed alleles only, as older checkers do."""
    table = [binomial(n + (1 if strict else 2), 2) for n in range(64)]
    k = n_alt + (1 if strict else 2)
    return F.coalesce(F.get(F.array(*map(F.lit, table)), n_alt), (k * (k - 1) / 2).cast("int"))


def expected_length(info: FieldInfo, n_alt: Column, strict: bool = False) -> Column | None:
    """How many values a list field should have; None where any number will do."""
    if info.number == "A":
        return n_alt
    if info.number == "R":
        return n_alt + 1
    if info.number == "G":
        return _genotypes(n_alt, strict)
    if isinstance(info.number, int) and info.number > 1:
        return F.lit(info.number)
    return None


def _warn(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def _length_warnings(map_: Column, kind: str, infos: dict[str, FieldInfo], n_alt: Column) -> list[Column]:
    out = []
    for key, info in infos.items():
        expected = expected_length(info, n_alt)
        if expected is None or key == "FT":
            continue
        text = F.try_element_at(map_, F.lit(key))
        n = F.size(F.split(text, ","))
        bad = text.isNotNull() & (text != ".") & (n != expected)
        message = F.concat(F.lit(f"{kind} {key} has "), n.cast("string"), F.lit(" values, not "), expected.cast("string"))
        out.append(F.when(bad, _warn("IncorrectListLength", message)))
    return out


def warnings_column(header: Header, checks: Sequence[str] = ()) -> Column:
    """All warnings of a record: unknown filters, values that do not convert, and list lengths if asked for."""
    from ..plans.variants import field_infos

    unknown = lambda xs, where: F.transform(unknown_filters(xs, header), lambda f: _warn("UnknownFilter", F.concat(F.lit(f"{where} holds "), f, F.lit(", which the header does not declare"))))
    parts = [unknown(F.col("filter"), "FILTER")]
    info = field_infos(header, "INFO", None)
    single = [F.when(fields.unconverted(F.col("info"), k, f), _warn("CannotConvertValue", F.concat(F.lit(f"{k}: "), F.try_element_at("info", F.lit(k)), F.lit(f" is no {f.type}, its text is kept")))) for k, f in info.items() if f.type in ("Integer", "Float")]
    n_alt = F.size("alt")
    if "INFO" in checks:
        single += _length_warnings(F.col("info"), "INFO", info, n_alt)
    if single:
        parts.append(F.array_compact(F.array(*single)))
    if header.samples.names:
        if "FORMAT" in checks:
            known = field_infos(header, "FORMAT", None)
            found = lambda c: F.array_compact(F.array(*_length_warnings(c["data"], "FORMAT", known, n_alt))) if _length_warnings(c["data"], "FORMAT", known, n_alt) else F.array().cast(_NONE)
            parts.append(F.flatten(F.transform(F.filter("calls", lambda c: c["parsed"]), found)))
        parts.append(F.flatten(F.transform(F.filter("calls", lambda c: c["ft"].isNotNull()), lambda c: unknown(c["ft"], "FORMAT/FT"))))
    return F.concat(*[F.coalesce(p.cast(_NONE), F.array().cast(_NONE)) for p in parts])


def warning_summary(variants: DataFrame) -> DataFrame:
    """How often each warning occurs."""
    # Outer: a plain explode has the optimizer infer filters that work the warnings out again.
    w = variants.select(F.explode_outer("warnings").alias("w")).where(F.col("w").isNotNull())
    return w.groupBy(F.col("w.code").alias("code"), F.col("w.message").alias("message")).agg(F.count("*").alias("n"))
