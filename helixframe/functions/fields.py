"""Field texts: escaping, typed decoding, key-value maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.header import FieldInfo

# The format's percent escapes, in the order they are undone.
ESCAPES = (("%25", "%"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%2C", ","), ("%0D", "\r"), ("%0A", "\n"), ("%09", "\t"))
RESERVED_IN_INFO, RESERVED_IN_FORMAT = "[;=%,\\r\\n\\t]", "[:=%,\\r\\n\\t]"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"^\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used.

    Inside lambdas and pushed-down predicates nothing else keeps a plan from
    repeating it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column) -> Column:
    """The value, behind a fence: predicates on what is made of it are not pushed below.

    There they would repeat, for each use, all that it takes to make it.  The
    fence is an expression that the optimizer may not move and that costs
    nothing for a row.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def unescape(value: Column) -> Column:
    """Percent escapes undone one kind after the other, ``%25`` first."""

    def undone(x: Column) -> Column:
        out = x
        for code, char in ESCAPES:
            out = F.replace(out, F.lit(code), F.lit(char))
        return F.when(F.contains(x, F.lit("%")), out).otherwise(x)

    return let(value, undone)


def escape(value: Column, reserved: str) -> Column:
    """All mapped characters escaped, if any of ``reserved`` is present; null becomes a dot."""
    out = value
    for code, char in ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(code))
    return F.when(value.isNull(), F.lit(".")).when(value.rlike(reserved), out).otherwise(value)


def escape_info(value: Column) -> Column:
    return escape(value, RESERVED_IN_INFO)


def escape_format(value: Column) -> Column:
    return escape(value, RESERVED_IN_FORMAT)


def list_or_empty(text: Column, delimiter: str) -> Column:
    """Parts of a delimited field; a dot is the empty list."""
    return F.when(text == ".", F.array().cast("array<string>")).otherwise(F.split(text, delimiter))


def number(text: Column, kind: str) -> Column:
    """A number, or null where the text is none."""
    pattern, to = (_INTEGER, "bigint") if kind == "Integer" else (_FLOAT, "double")
    return let(text, lambda x: F.when(x.rlike(pattern), F.trim(x).try_cast(to)))


def atom(text: Column, kind: str) -> Column:
    """One value of a declared type; a dot is null."""
    known = F.nullif(text, F.lit("."))
    return number(known, kind) if kind in ("Integer", "Float") else unescape(known)


def spark_type(info: FieldInfo) -> str:
    base = {"Integer": "bigint", "Float": "double", "Flag": "boolean"}.get(info.type, "string")
    single = info.number == 1 and info.id != "FT"
    return base if single or info.type == "Flag" else f"array<{base}>"


def typed(map_: Column, key: str, info: FieldInfo) -> Column:
    """A field of a key-value map in its declared type.

    Absent keys are null (flags: false).  Lists: a dot is the empty list, a dot
    among values a null.  Values that do not convert are null; the map keeps
    their text.
    """
    if info.type == "Flag":
        return F.map_contains_key(map_, key)
    text = F.try_element_at(map_, F.lit(key))
    if key == "FT":
        return F.filter(F.split(text, ";"), lambda x: x != ".")
    if info.number == 1:
        return atom(text, info.type)
    return let(text, lambda t: F.when(t == ".", F.array().cast(spark_type(info))).otherwise(F.transform(F.split(t, ","), lambda x: atom(x, info.type))))


def unconverted(map_: Column, key: str, info: FieldInfo) -> Column:
    """Whether a numeric field holds a value that is no number."""
    if info.type not in ("Integer", "Float"):
        return F.lit(False)
    parts = F.split(F.try_element_at(map_, F.lit(key)), "$^" if info.number == 1 else ",")
    return F.coalesce(F.exists(parts, lambda x: (x != ".") & number(x, info.type).isNull()), F.lit(False))


def info_map(text: Column) -> Column:
    """INFO as an ordered map of texts: flags have null, of repeated keys the last value counts."""
    entry = lambda x: F.struct(
        F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1)).alias("v")
    )
    empty = F.create_map().cast("map<string,string>")
    return let(text, lambda t: F.when(t == ".", empty).otherwise(last_wins(F.transform(F.split(t, ";"), entry))))


def last_wins(entries: Column) -> Column:
    """A map of key-value structs; of repeated keys the first one's place and the last one's value."""

    def built(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["k"])
        last = lambda k: F.struct(k.alias("k"), F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"].alias("v"))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(es), es).otherwise(F.transform(F.array_distinct(keys), last)))

    return let(entries, built)


def call_map(format_: Column, text: Column) -> Column:
    """A call's texts by FORMAT key: short lists end early, surplus values are dropped."""
    pairs = lambda vs: F.slice(F.zip_with(format_, vs, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), F.lit(1), F.least(F.size(format_), F.size(vs)))
    return last_wins(let(F.split(text, ":"), pairs))
