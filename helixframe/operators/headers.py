"""Header lines as a DataFrame, and the operators over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import let
from ..plans.header import FORMAT_TYPES, INFO_TYPES, MAPPED, NUMBER_CODES, QUOTED, RESERVED_FORMAT, RESERVED_INFO, SUPPORTED_VERSIONS, Header
from .names import unused

SCHEMA = "idx int, key string, id string, value string, mapping array<struct<k:string,v:string>>"


def header_lines(spark: SparkSession, header: Header) -> DataFrame:
    rows = [(i, x.key, x.id, x.value, [(k, str(v)) for k, v in x.mapping.items()] if x.mapping else None) for i, x in enumerate(header.lines)]
    return spark.createDataFrame(rows, SCHEMA)


def parse_header_lines(lines: DataFrame) -> DataFrame:
    """``key, value, attributes, id`` of each ``##`` line in a ``value`` column, other columns kept before them.

    ``attributes`` maps names to texts, for lines whose value is a mapping: quoted
    strings without their quotes and escapes, lists as they stand, flags as null.
    """
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in ("key", "value", "attributes", "id")]
    body = lines.where(F.startswith("value", F.lit("##")) & F.contains("value", F.lit("=")))
    text = F.regexp_replace("value", r"\s+$", "")
    key = F.substr(F.substring_index(text, "=", 1), F.lit(3))
    value = F.substr(text, F.instr(text, "=") + 1)
    attributes = F.when(key.isin(*MAPPED) & value.rlike("^<.*>$"), mapping_column(value))
    out = body.select(*kept, key.alias("key"), value.alias("value"), attributes.alias("attributes"))
    return out.withColumn("id", F.try_element_at("attributes", F.lit("ID")))


#: A name, and after an equals sign a quoted string, a list, or a bare word.
_ATTRIBUTE = r'([^=,<>]+)(?:=("(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,>]*))?'


def mapping_column(value: Column) -> Column:
    """The attributes of ``<name=value,...>`` texts as a map, in order."""
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    pairs = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0))

    def attribute(pair: Column) -> Column:
        text = F.when(F.contains(pair, F.lit("=")), F.substr(pair, F.instr(pair, "=") + 1))
        quoted = F.regexp_replace(F.substr(text, F.lit(2), F.length(text) - 2), r"\\(.)", "$1")
        return F.struct(F.trim(F.substring_index(pair, "=", 1)).alias("k"), F.when(text.rlike('^".*"$'), quoted).otherwise(text).alias("v"))

    # Of an attribute that is there twice the last counts.
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["k"] == e["k"]))
    return let(F.transform(pairs, attribute), lambda es: F.map_from_entries(last(es)))


def serialized() -> Column:
    """The text of rows from ``parse_header_lines``: attributes are written anew, quoted where need be."""

    def written(e: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        list_ = F.startswith(e["value"], F.lit("["))
        text = F.when(e["key"].isin(*QUOTED) | (~list_ & e["value"].rlike(r"[ \t]")), quoted).otherwise(e["value"])
        return F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), text))

    mapping = F.concat(F.lit("<"), F.array_join(F.transform(F.map_entries("attributes"), written), ","), F.lit(">"))
    return F.concat(F.lit("##"), F.col("key"), F.lit("="), F.coalesce(mapping, F.col("value")))


def field_types(lines: DataFrame) -> DataFrame:
    """``kind, key, type, number`` of declared fields; a type or number that is none counts as String and a dot."""
    of = lambda k: F.try_element_at("attributes", F.lit(k))
    info = F.col("key") == "INFO"
    known = F.when(info, of("Type").isin(*INFO_TYPES)).otherwise(of("Type").isin(*FORMAT_TYPES))
    number = F.when(of("Number").rlike(r"^-?[0-9]+$") | of("Number").isin(*NUMBER_CODES), of("Number")).otherwise(F.lit("."))
    fields = lines.where(F.col("key").isin("INFO", "FORMAT"))
    return fields.select(F.col("key").alias("kind"), F.col("id").alias("key"), F.when(known, of("Type")).otherwise(F.lit("String")).alias("type"), number.alias("number"))


def line_problems(lines: DataFrame) -> DataFrame:
    """``key, id, problem`` for each thing amiss with a line from ``parse_header_lines``; the problems are the names of warnings."""
    of = lambda k: F.try_element_at("attributes", F.lit(k))
    field = F.col("key").isin("INFO", "FORMAT")
    known = F.when(F.col("key") == "INFO", of("Type").isin(*INFO_TYPES)).otherwise(of("Type").isin(*FORMAT_TYPES))
    problems = F.array(
        F.when(F.col("attributes").isNotNull() & F.col("id").isNull(), "InvalidHeaderException"),
        F.when(field & of("Number").isNull(), "FieldMissingNumber"),
        F.when(field & ~of("Number").rlike(r"^-?[0-9]+$") & ~of("Number").isin(*NUMBER_CODES), "FieldInvalidNumber"),
        F.when(field & ~F.coalesce(known, F.lit(False)), "HeaderInvalidType"),
        F.when(F.col("key").isin("INFO", "FORMAT", "FILTER") & of("Description").isNull(), "HeaderMissingDescription"),
        F.when((F.col("key") == "contig") & of("length").isNull(), "FieldInfoNotFound"),
        F.when((F.col("key") == "fileformat") & ~F.col("value").isin(*SUPPORTED_VERSIONS), "UnknownVCFVersion"),
    )
    return lines.select("key", "id", F.explode(F.array_compact(problems)).alias("problem"))


def column_samples(value: Column) -> Column:
    """Sample names of a ``#CHROM`` line."""
    columns = F.split(F.regexp_replace(value, r"\s+$", ""), "\t")
    return F.slice(columns, 10, F.greatest(F.size(columns) - 9, F.lit(0)))


def first_of_each(lines: DataFrame) -> DataFrame:
    """Lines without later duplicates of a key and id."""
    first = F.row_number().over(Window.partitionBy("key", "id").orderBy("idx"))
    n = unused("n", lines)
    return lines.withColumn(n, F.when(F.col("id").isNotNull(), first).otherwise(F.lit(1))).where(F.col(n) == 1).drop(n)


def without_lines(lines: DataFrame, remove: DataFrame) -> DataFrame:
    """Lines that ``remove`` (``key, id``) does not name; a line without id goes by its value."""
    name = F.coalesce(lines["id"], lines["value"])
    return lines.join(remove, (lines["key"] == remove["key"]) & (name == remove["id"]), "left_anti")


def reserved_fields(spark: SparkSession) -> DataFrame:
    rows = [(kind, k, f.type, str(f.number)) for kind, table in (("INFO", RESERVED_INFO), ("FORMAT", RESERVED_FORMAT)) for k, f in table.items()]
    return spark.createDataFrame(rows, "kind string, key string, type string, number string")


def resolve_fields(keys: DataFrame, declared: DataFrame, reserved: DataFrame) -> DataFrame:
    """Type and number of each ``kind, key``: declared, else reserved, else String and a dot; ``source`` tells which."""
    d = declared.select("kind", "key", F.col("type").alias("d_type"), F.col("number").alias("d_number"))
    r = reserved.select("kind", "key", F.col("type").alias("r_type"), F.col("number").alias("r_number"))
    out = keys.join(d, ["kind", "key"], "left").join(r, ["kind", "key"], "left")
    source = F.when(F.col("d_type").isNotNull(), "declared").when(F.col("r_type").isNotNull(), "reserved").otherwise("default")
    return out.select("kind", "key", F.coalesce("d_type", "r_type", F.lit("String")).alias("type"), F.coalesce("d_number", "r_number", F.lit(".")).alias("number"), source.alias("source"))
