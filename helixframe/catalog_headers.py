"""Registered queries of the header operators and of list-length checks, and the same results as SQL.

Header lines are rendered from ``part`` by SQL that both engines read alike.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FIXTURE, ORACLES, QUERIES, header, lines, variants
from .functions import genotypes
from .operators import check, edit, headers, render, samples
from .plans.header import FieldInfo, HeaderLine, header_without_lines, parse_header, parse_sample_line
from .plans.variants import parse_records

#: Header lines and the parts they are made of, from ``{part}``.
LINES = """
SELECT idx, kind, id, num, typ, descr, contig_length, p_type, '##' || kind || '=' || CASE WHEN kind IN ('source', 'fileformat') THEN descr ELSE
  '<ID=' || id || coalesce(',Number=' || num, '') || coalesce(',Type=' || typ, '') || coalesce(',length=' || contig_length, '') || extra
  || coalesce(',Description=' || chr(34) || replace(descr, chr(34), chr(92) || chr(34)) || chr(34), '') || '>' END AS value
FROM (SELECT p_partkey AS idx, p_type, 'K' || CAST(p_partkey AS VARCHAR(20)) AS id,
 CASE p_partkey % 9 WHEN 0 THEN 'INFO' WHEN 1 THEN 'FORMAT' WHEN 2 THEN 'FILTER' WHEN 3 THEN 'contig' WHEN 4 THEN 'ALT' WHEN 5 THEN 'META'
   WHEN 6 THEN 'source' WHEN 7 THEN 'PEDIGREE' ELSE 'fileformat' END AS kind,
 CASE WHEN p_partkey % 9 < 2 THEN CASE p_size % 7 WHEN 0 THEN '1' WHEN 1 THEN 'A' WHEN 2 THEN 'R' WHEN 3 THEN 'G' WHEN 4 THEN '.' WHEN 5 THEN 'X' END END AS num,
 CASE WHEN p_partkey % 9 < 2 THEN CASE p_size % 5 WHEN 0 THEN 'Integer' WHEN 1 THEN 'Float' WHEN 2 THEN 'Flag' WHEN 3 THEN 'String' ELSE 'Text' END END AS typ,
 CASE WHEN p_partkey % 9 = 6 THEN p_name || '=' || p_type WHEN p_partkey % 9 = 8 THEN 'VCFv4.' || CAST(p_size % 6 AS VARCHAR(9))
   WHEN p_partkey % 9 IN (0, 1, 2, 4) AND p_size % 4 <> 0 THEN p_name || ', of ' || chr(34) || p_type || chr(34) || ' = [' || p_brand || ']' END AS descr,
 CASE WHEN p_partkey % 9 = 3 AND p_size % 3 <> 0 THEN CAST(p_size * 1000 AS VARCHAR(20)) END AS contig_length,
 CASE p_partkey % 9 WHEN 3 THEN ',assembly=B36' WHEN 5 THEN ',Values=[a, ' || p_type || ']' WHEN 7 THEN ',Father=F,Verified' ELSE '' END AS extra
 FROM {part}) p
"""


def header_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``idx, value``: the rendered lines."""
    return spark.sql(f"SELECT idx, value FROM ({LINES})", part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _query(oracle: str):
    """Register a query with its SQL over ``h``, the rendered lines, and ``v``, the rendered records."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH h AS ({LINES.format(part='part')}), v AS ({FIXTURE.format(lineitem='lineitem')})\n{oracle}"
        return f

    return add


_PLAIN = "kind IN ('source', 'fileformat')"


@_query(f"SELECT idx::BIGINT AS idx, kind AS key, substr(value, length(kind) + 4) AS value, CASE WHEN NOT {_PLAIN} THEN id END AS id FROM h")
def header_lines_split(spark, sf_dir):
    """Lines taken apart: key, value and id; plain lines and those with a mapping."""
    return headers.parse_header_lines(header_frame(spark, sf_dir)).select(F.col("idx").cast("bigint").alias("idx"), "key", "value", "id")


@_query(f"""SELECT idx::BIGINT AS idx, name, text FROM (
 SELECT idx, 'ID' AS name, id AS text FROM h WHERE NOT {_PLAIN} UNION ALL SELECT idx, 'Number', num FROM h WHERE num IS NOT NULL UNION ALL SELECT idx, 'Type', typ FROM h WHERE typ IS NOT NULL
 UNION ALL SELECT idx, 'length', contig_length FROM h WHERE contig_length IS NOT NULL UNION ALL SELECT idx, 'assembly', 'B36' FROM h WHERE kind = 'contig'
 UNION ALL SELECT idx, 'Values', '[a, ' || p_type || ']' FROM h WHERE kind = 'META' UNION ALL SELECT idx, 'Father', 'F' FROM h WHERE kind = 'PEDIGREE'
 UNION ALL SELECT idx, 'Verified', NULL FROM h WHERE kind = 'PEDIGREE' UNION ALL SELECT idx, 'Description', descr FROM h WHERE descr IS NOT NULL AND NOT {_PLAIN})""")
def header_attributes(spark, sf_dir):
    """Attributes of mappings: quoted texts with commas and escapes, lists, bare words, flags."""
    parsed = headers.parse_header_lines(header_frame(spark, sf_dir))
    return parsed.select(F.col("idx").cast("bigint").alias("idx"), F.explode("attributes").alias("name", "text"))


@_query("SELECT idx::BIGINT AS idx, value AS line FROM h")
def header_serialize(spark, sf_dir):
    """Lines written anew from their parts."""
    parsed = headers.parse_header_lines(header_frame(spark, sf_dir))
    return parsed.select(F.col("idx").cast("bigint").alias("idx"), headers.serialized().alias("line"))


@_query("""SELECT kind, id AS key, CASE WHEN typ = 'Text' OR kind = 'FORMAT' AND typ = 'Flag' THEN 'String' ELSE typ END AS type,
 CASE WHEN num IS NULL OR num = 'X' THEN '.' ELSE num END AS number FROM h WHERE kind IN ('INFO', 'FORMAT')""")
def header_field_types(spark, sf_dir):
    """Types and numbers of declared fields, with what stands in for bad ones."""
    return headers.field_types(headers.parse_header_lines(header_frame(spark, sf_dir)))


@_query("""SELECT kind AS key, CASE WHEN kind <> 'fileformat' THEN id END AS id, problem FROM (
 SELECT *, 'FieldMissingNumber' AS problem FROM h WHERE kind IN ('INFO', 'FORMAT') AND num IS NULL UNION ALL SELECT *, 'FieldInvalidNumber' FROM h WHERE num = 'X'
 UNION ALL SELECT *, 'HeaderInvalidType' FROM h WHERE typ = 'Text' OR kind = 'FORMAT' AND typ = 'Flag'
 UNION ALL SELECT *, 'HeaderMissingDescription' FROM h WHERE kind IN ('INFO', 'FORMAT', 'FILTER') AND descr IS NULL
 UNION ALL SELECT *, 'FieldInfoNotFound' FROM h WHERE kind = 'contig' AND contig_length IS NULL
 UNION ALL SELECT *, 'UnknownVCFVersion' FROM h WHERE kind = 'fileformat' AND descr IN ('VCFv4.4', 'VCFv4.5'))""")
def header_problems(spark, sf_dir):
    """What is amiss with lines: versions, numbers, types, descriptions, lengths."""
    return headers.line_problems(headers.parse_header_lines(header_frame(spark, sf_dir)))


@_query(f"SELECT kind AS key, count(*)::BIGINT AS n, min(id) AS first_id, max(id) AS last_id FROM h WHERE NOT {_PLAIN} GROUP BY kind")
def header_ids(spark, sf_dir):
    """Ids by kind of line."""
    parsed = headers.parse_header_lines(header_frame(spark, sf_dir)).where("id IS NOT NULL")
    return parsed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _model(spark: SparkSession, sf_dir: str):
    """The rendered lines as one header on the driver, where headers live."""
    rows = sorted((r.idx, r.value) for r in header_frame(spark, sf_dir).where("value NOT LIKE '##fileformat=%'").collect())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return parse_header(["##fileformat=VCFv4.2", *(v for _, v in rows), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"])


@_query("""SELECT line FROM (SELECT '##fileformat=VCFv4.2' AS line UNION ALL SELECT '#CHROM' || replace(' POS ID REF ALT QUAL FILTER INFO FORMAT a b', ' ', chr(9))
 UNION ALL SELECT '##' || kind || '=' || replace(substr(value, length(kind) + 4), CASE WHEN kind IN ('INFO', 'FORMAT') AND num = 'X' THEN ',Number=X' ELSE '?' END, ',Number=.')
   FROM h WHERE kind IN ('source', 'FILTER', 'contig', 'ALT', 'META') OR kind IN ('INFO', 'FORMAT') AND num IS NOT NULL)""")
def header_model_text(spark, sf_dir):
    """A whole header parsed into the model, without some lines, and written again."""
    h = _model(spark, sf_dir)
    gone = [(x.key, x.id) for x in h.lines if x.key == "PEDIGREE" or x.key in ("INFO", "FORMAT") and "Number=" not in (x.raw or "")]
    return spark.createDataFrame([(x,) for x in header_without_lines(h, gone).copy().to_text().splitlines()], "line string")


@_query("""SELECT question, answer FROM (SELECT 'info ids' AS question, count(*)::BIGINT AS answer FROM h WHERE kind = 'INFO' UNION ALL SELECT 'format ids', count(*) FROM h WHERE kind = 'FORMAT'
 UNION ALL SELECT 'filter ids', count(*) + 1 FROM h WHERE kind = 'FILTER' UNION ALL SELECT 'contigs', count(*) + 1 FROM h WHERE kind = 'contig' UNION ALL SELECT 'source lines', count(*) FROM h WHERE kind = 'source'
 UNION ALL SELECT 'new lines added', 4 UNION ALL SELECT 'duplicates passed over', 1 UNION ALL SELECT 'lines in all', count(*) + 6 FROM h WHERE kind <> 'fileformat'
 UNION ALL SELECT 'has', 1 UNION ALL SELECT 'has not', 0 UNION ALL SELECT 'samples', 2 UNION ALL SELECT 'equal to its copy', 1 UNION ALL SELECT 'equal after a change', 0)""")
def header_model_edits(spark, sf_dir):
    """Lines added, looked up and counted in the model."""
    h = _model(spark, sf_dir)
    before = h.copy()
    same = int(before == h)
    ids = len(h.info_ids()), len(h.format_ids())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        added = [
            h.add_filter_line({"ID": "new", "Description": "d"}), h.add_contig_line({"ID": "new", "length": 5}), h.add_info_line({"ID": "new", "Number": 1, "Type": "Flag", "Description": "d"}),
            h.add_line(HeaderLine.from_mapping("FORMAT", {"ID": "new", "Number": 1, "Type": "String", "Description": "d"})), h.add_format_line({"ID": "new", "Number": 1, "Type": "String", "Description": "d"}),
        ]
    rows = [
        ("info ids", ids[0]), ("format ids", ids[1]), ("filter ids", len(h.filter_ids())), ("contigs", len(h.contigs())), ("source lines", len(h.get_lines("source"))), ("new lines added", sum(added)),
        ("duplicates passed over", len(added) - sum(added)), ("lines in all", len(h.lines)), ("has", int(h.has_header_line("INFO", "new"))), ("has not", int(h.has_header_line("INFO", "none"))),
        ("samples", len(parse_sample_line(h.column_line()).names)), ("equal to its copy", same), ("equal after a change", int(before == h)),
    ]
    return spark.createDataFrame(rows, "question string, answer bigint")


@_query("""SELECT n_regionkey::BIGINT AS region, n_name AS sample, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::BIGINT AS place FROM nation""")
def header_samples(spark, sf_dir):
    """Sample names of ``#CHROM`` lines, in order."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.concat(F.lit("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", ""])), F.array_join(F.array_sort(F.collect_list("n_name")), "\t"))
    rows = n.groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(line.alias("value"))
    return rows.select("region", F.posexplode(headers.column_samples(F.col("value"))).alias("place", "sample")).select("region", "sample", F.col("place").cast("bigint").alias("place"))


@_query("SELECT count(*)::BIGINT AS n, sum(CASE WHEN kind = 'contig' THEN contig_length::BIGINT END)::BIGINT AS total FROM h WHERE kind = 'contig' AND contig_length IS NOT NULL")
def contig_lengths(spark, sf_dir):
    """Lengths of declared sequences."""
    parsed = headers.parse_header_lines(header_frame(spark, sf_dir)).where("key = 'contig'")
    length = F.try_element_at("attributes", F.lit("length")).cast("bigint")
    return parsed.agg(F.count(length).alias("n"), F.sum(length).alias("total"))


# Records whose lists are of many lengths, by place.
_N_ALT = "CASE WHEN alt = '.' THEN 0 ELSE length(alt) - length(replace(alt, ',', '')) + 1 END"
_LIST = "substr('1,2,3,4,5,6,7', 1, 2 * {} - 1)"
_LENGTH_LINE = (
    "chrom || chr(9) || CAST(pos AS VARCHAR(20)) || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || "
    f"'RR=' || {_LIST.format('CAST(pos % 4 + 1 AS INT)')} || ';GG=' || {_LIST.format('CAST(pos % 5 + 1 AS INT)')} || ';TT=' || {_LIST.format('CAST(pos % 3 + 1 AS INT)')} || chr(9) || 'GT:AD:PL:HQ:AA' || chr(9) || "
    f"'0/1:' || {_LIST.format('CAST(pos % 4 + 1 AS INT)')} || ':' || {_LIST.format('CAST(pos % 7 + 1 AS INT)')} || ':' || {_LIST.format('CAST(pos % 3 + 1 AS INT)')} || ':.'"
)
_LENGTH_HEADER = [
    "##fileformat=VCFv4.3",
    *(f'##INFO=<ID={k},Number={n},Type=Integer,Description="d">' for k, n in (("RR", "R"), ("GG", "G"), ("TT", 2))),
    *(f'##FORMAT=<ID={k},Number={n},Type={t},Description="d">' for k, n, t in (("GT", 1, "String"), ("AD", "R", "Integer"), ("PL", "G", "Integer"), ("HQ", 2, "Integer"), ("AA", "A", "Integer"))),
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts",
]


def _lengths(spark: SparkSession, sf_dir: str, checks: list[str]) -> DataFrame:
    from .catalog import lineitem

    rendered = spark.sql(f"SELECT {_LENGTH_LINE} AS value FROM ({FIXTURE})", lineitem=lineitem(spark, sf_dir))
    found = parse_records(rendered, parse_header(_LENGTH_HEADER), checks=checks)
    return check.warning_summary(found).where("code = 'IncorrectListLength'").select("message", "n")


def _length_sql(kind: str, fields: list[tuple[str, str, str]]) -> str:
    parts = [f"SELECT '{kind} {key} has ' || ({have})::VARCHAR || ' values, not ' || ({want})::VARCHAR AS message FROM a WHERE ({have}) <> ({want})" for key, have, want in fields]
    return f", a AS (SELECT *, {_N_ALT} AS n_alt FROM v) SELECT message, count(*)::BIGINT AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY message"


@_query(_length_sql("INFO", [("RR", "pos % 4 + 1", "n_alt + 1"), ("GG", "pos % 5 + 1", "(n_alt + 1) * (n_alt + 2) // 2"), ("TT", "pos % 3 + 1", "2")]))
def info_lengths_r_g_fixed(spark, sf_dir):
    """INFO lists that should hold one value for each allele, each genotype, or a fixed number."""
    return _lengths(spark, sf_dir, ["INFO"])


@_query(_length_sql("FORMAT", [("AD", "pos % 4 + 1", "n_alt + 1"), ("PL", "pos % 7 + 1", "(n_alt + 1) * (n_alt + 2) // 2"), ("HQ", "pos % 3 + 1", "2")]))
def format_lengths(spark, sf_dir):
    """Lists of calls that are too long or short; a dot is of any length."""
    return _lengths(spark, sf_dir, ["FORMAT"])


@_query("SELECT 0::BIGINT AS n FROM (SELECT 1)")
def no_length_checks(spark, sf_dir):
    """Without checks asked for, no list is too long or short."""
    return _lengths(spark, sf_dir, []).agg(F.count("*").alias("n"))


@_query(f"SELECT chrom, sum((n_alt + 1) * (n_alt + 2) // 2)::BIGINT AS genotypes, sum(n_alt * (n_alt + 1) // 2)::BIGINT AS strict FROM (SELECT chrom, {_N_ALT} AS n_alt FROM v) GROUP BY chrom")
def genotype_numbers(spark, sf_dir):
    """How many genotypes the alleles of a record allow: binomial coefficients."""
    v = variants(spark, sf_dir)
    info = FieldInfo("Integer", "G")
    return v.select("chrom", check.expected_length(info, F.size("alt")).alias("g"), check.expected_length(info, F.size("alt"), strict=True).alias("s")).groupBy("chrom").agg(F.sum("g").cast("bigint").alias("genotypes"), F.sum("s").cast("bigint").alias("strict"))


@_query("SELECT chrom, pos::BIGINT AS pos, 's2' AS sample, split_part(s2, ':', 1) AS gt, 0::INT AS lists FROM v")
def update_calls(spark, sf_dir):
    """Calls replaced: here the other way round, and without filters."""
    v = edit.update_calls(variants(spark, sf_dir), F.transform(F.reverse("calls"), lambda c: c.withField("ft", F.lit(None).cast("array<string>"))))
    v = v.withColumn("c", F.get("calls", F.lit(0)))
    return v.select("chrom", "pos", "c.sample", "c.gt", F.size(F.filter("calls", lambda c: c["ft"].isNotNull())).alias("lists"))


@_query("SELECT chrom || chr(9) || pos::VARCHAR || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || filter || chr(9) || info || chr(9) || 'GT:DP:FT' || chr(9) || CASE WHEN s2 = '0/0' THEN '0/0:.:.' ELSE s2 END AS line FROM v")
def subset_write(spark, sf_dir):
    """Lines with one of two samples."""
    v, h = samples.select_samples(variants(spark, sf_dir), header(), ["s2"])
    return v.select(render.record_line(h).alias("line"))


@_query("SELECT chrom, count(*)::BIGINT AS n, sum(pos)::BIGINT AS places, 0::BIGINT AS n_calls, 0::BIGINT AS n_format, count(try_cast(qual AS DOUBLE))::BIGINT AS n_qual FROM v GROUP BY chrom")
def no_samples(spark, sf_dir):
    """Records of a file without samples: eight columns, no calls."""
    h = header_without_lines(header(), [])
    h.samples = parse_sample_line("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")
    cut = lines(spark, sf_dir).select(F.substring_index("value", "\t", 8).alias("value"))
    v = parse_records(cut, h)
    return v.groupBy("chrom").agg(
        F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("places"), F.sum(F.size("calls")).cast("bigint").alias("n_calls"), F.sum(F.size("format")).cast("bigint").alias("n_format"), F.count("qual").alias("n_qual")
    )


@_query("SELECT chrom, pos::BIGINT AS pos, 's1' AS sample, split_part(s1, ':', 1) AS raw_gt, length(split_part(s1, ':', 1)) > 1 AND contains(split_part(s1, ':', 1), '.') OR split_part(s1, ':', 1) = '.' AS missing FROM v")
def call_missing_alleles(spark, sf_dir):
    """Calls of the first sample with an allele missing, and the text of their genotype."""
    v = variants(spark, sf_dir).withColumn("c", samples.call_for_sample(F.col("calls"), "s1"))
    al = genotypes.gt_alleles(F.col("c.gt"))
    return v.select("chrom", "pos", "c.sample", F.coalesce("c.gt", F.lit(".")).alias("raw_gt"), F.coalesce(F.exists(al, lambda a: a.isNull()), F.lit(True)).alias("missing"))
