"""Registered queries of the variant operators, and the same results as SQL.

The tables hold no VCF, so ``lineitem`` is rendered as record lines by SQL that
both engines read alike; the queries parse those lines with the engine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alleles, bins, fields, genotypes
from .operators import check, edit, headers, region, render, samples
from .plans.header import Header, SamplesInfos, parse_header
from .plans.variants import parse_records
from .sources import read, write
from .streaming.lines import read_stream

#: Record columns rendered from ``{lineitem}``, valid in both engines.
FIXTURE = """
SELECT 'chr' || CAST(l_suppkey % 22 + 1 AS VARCHAR(9)) AS chrom,
 l_orderkey * 10 + l_linenumber AS pos,
 CASE WHEN l_linenumber % 3 = 0 THEN '.' WHEN l_linenumber % 3 = 1 THEN 'rs' || CAST(l_partkey AS VARCHAR(20))
      ELSE 'rs' || CAST(l_partkey AS VARCHAR(20)) || ';s' || CAST(l_suppkey AS VARCHAR(20)) END AS id,
 CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'AT' WHEN 3 THEN 'GTC' ELSE 'G' END AS ref,
 CASE l_suppkey % 11 WHEN 0 THEN 'T' WHEN 1 THEN 'G,T' WHEN 2 THEN 'A' WHEN 3 THEN 'G,GTCT' WHEN 4 THEN '.'
   WHEN 5 THEN '<DEL>' WHEN 6 THEN 'G]17:198982]' WHEN 7 THEN '.A' WHEN 8 THEN '[<ctg>:5[TT' WHEN 9 THEN '*,C' ELSE 'CT' END AS alt,
 CASE WHEN l_linenumber % 4 = 0 THEN '.' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END AS qual,
 CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'q10;s50' ELSE '.' END AS filter,
 'DP=' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || ';AF=0.5,.'
   || CASE WHEN l_linestatus = 'O' THEN ';DB' ELSE '' END
   || CASE WHEN l_linenumber % 2 = 0 THEN ';ANNO=a%2Cb,%2525' ELSE '' END
   || CASE WHEN l_linenumber % 5 = 0 THEN ';NS=x7' ELSE '' END AS info,
 CASE l_partkey % 7 WHEN 0 THEN '0/0' WHEN 1 THEN '0|1' WHEN 2 THEN '1/1' WHEN 3 THEN './.' WHEN 4 THEN '.'
   WHEN 5 THEN '0/.' ELSE '1' END || ':' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || ':PASS' AS s1,
 CASE l_linenumber % 3 WHEN 0 THEN '0/1:3:PASS' WHEN 1 THEN '1|1:4:q10;s50' ELSE '0/0' END AS s2
FROM {lineitem}
"""
COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
HEADER = """##fileformat=VCFv4.3
##source=lineitem
##FILTER=<ID=q10,Description="Quality below 10">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Total depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=ANNO,Number=.,Type=String,Description="Annotation">
##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples with data">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=FT,Number=1,Type=String,Description="Filters">
##contig=<ID=chr1,length=100>
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2
"""
_LINE = "chrom || chr(9) || CAST(pos AS VARCHAR(20)) || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || filter || chr(9) || info || chr(9) || 'GT:DP:FT' || chr(9) || s1 || chr(9) || s2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def header() -> Header:
    return parse_header(HEADER.splitlines())


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that records are rendered from."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS)
    parallel = spark.sparkContext.defaultParallelism
    if len(table.inputFiles()) < parallel:
        # A file of one row group is one task, however it is split: the narrow raw rows are dealt out before they are parsed.
        table = table.repartition(parallel, "l_orderkey", "l_linenumber")
    return table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines rendered from ``lineitem``."""
    rendered = spark.sql(f"SELECT {_LINE} AS value FROM ({FIXTURE})", lineitem=lineitem(spark, sf_dir))
    return rendered.select(fields.once(F.col("value")).alias("value"))


def variants(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return parse_records(lines(spark, sf_dir), header(), **options)


def _query(oracle: str | None = None):
    """Register a query under its name, with its SQL over ``v``, the rendered columns."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"WITH v AS ({FIXTURE.format(lineitem='lineitem')})\n{oracle}"
        return f

    return add


_TYPE = """CASE WHEN regexp_matches(a, '[\\[\\]]') THEN 'BND' WHEN starts_with(a, '.') OR ends_with(a, '.') THEN 'BND'
 WHEN starts_with(a, '<') AND ends_with(a, '>') THEN 'SYMBOLIC'
 WHEN length(ref) = length(a) THEN CASE WHEN length(ref) = 1 THEN 'SNV' ELSE 'MNV' END
 WHEN length(ref) > length(a) THEN CASE WHEN length(a) = 1 AND left(ref, 1) = left(a, 1) THEN 'DEL' ELSE 'INDEL' END
 ELSE CASE WHEN length(ref) = 1 AND left(ref, 1) = left(a, 1) THEN 'INS' ELSE 'INDEL' END END"""
_ALLELES = f"e AS (SELECT *, unnest(string_split(alt, ',')) AS a FROM v WHERE alt <> '.'), t AS (SELECT *, {_TYPE} AS type FROM e)"
_TYPES = f"list_transform(CASE WHEN alt = '.' THEN [] ELSE string_split(alt, ',') END, lambda a: {_TYPE})"


@_query(f", {_ALLELES} SELECT chrom, type, count(*)::BIGINT AS n FROM t GROUP BY chrom, type")
def alt_type_counts(spark, sf_dir):
    """Types of alternative alleles by chromosome."""
    v = variants(spark, sf_dir)
    return samples.explode_alleles(v, "chrom").groupBy("chrom", F.col("allele.type").alias("type")).agg(F.count("*").alias("n"))


@_query("""SELECT chrom, pos::BIGINT AS pos, (pos - 1)::BIGINT AS begin_pos, ref, alt,
 CASE WHEN id = '.' THEN 0 ELSE len(string_split(id, ';')) END::INT AS n_ids, CASE WHEN filter = '.' THEN '' ELSE replace(filter, ';', '+') END AS filters,
 try_cast(qual AS DOUBLE) AS qual FROM v""")
def record_projection(spark, sf_dir):
    """Fixed fields of every record."""
    v = variants(spark, sf_dir)
    alt = F.array_join(F.transform("alt", lambda a: a["raw"]), ",")
    return v.select("chrom", "pos", F.col("begin").alias("begin_pos"), "ref", F.when(alt == "", ".").otherwise(alt).alias("alt"), F.size("id").alias("n_ids"), F.array_join("filter", "+").alias("filters"), "qual")


@_query("SELECT i AS id, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(id, ';')) AS i FROM v WHERE id <> '.') GROUP BY i")
def id_explode(spark, sf_dir):
    """How often each id occurs."""
    return variants(spark, sf_dir).select(F.explode("id").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


@_query("SELECT f AS filter, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(filter, ';')) AS f FROM v WHERE filter <> '.') GROUP BY f")
def filter_explode_counts(spark, sf_dir):
    """How often each filter occurs."""
    return variants(spark, sf_dir).select(F.explode("filter").alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))


@_query("SELECT chrom, count(try_cast(qual AS DOUBLE))::BIGINT AS n, sum(try_cast(qual AS DOUBLE)) AS total, min(try_cast(qual AS DOUBLE)) AS least, max(try_cast(qual AS DOUBLE)) AS most FROM v GROUP BY chrom")
def qual_stats(spark, sf_dir):
    """Quality by chromosome."""
    v = variants(spark, sf_dir)
    return v.groupBy("chrom").agg(F.count("qual").alias("n"), F.sum("qual").alias("total"), F.min("qual").alias("least"), F.max("qual").alias("most"))


@_query("SELECT chrom, sum(regexp_extract(info, 'DP=([0-9]+)', 1)::BIGINT)::BIGINT AS depth, max(regexp_extract(info, 'DP=([0-9]+)', 1)::BIGINT)::BIGINT AS most FROM v GROUP BY chrom")
def info_dp_typed(spark, sf_dir):
    """A typed INFO number, aggregated."""
    return variants(spark, sf_dir, info=["DP"]).groupBy("chrom").agg(F.sum("info_t.DP").alias("depth"), F.max("info_t.DP").alias("most"))


@_query("SELECT list_contains(string_split(info, ';'), 'DB') AS known, count(*)::BIGINT AS n FROM v GROUP BY 1")
def info_flag_db(spark, sf_dir):
    """A flag's presence."""
    return variants(spark, sf_dir, info=["DB"]).groupBy(F.col("info_t.DB").alias("known")).agg(F.count("*").alias("n"))


@_query("SELECT chrom, pos::BIGINT AS pos, 2::INT AS n_values, 1::INT AS n_missing, 0.5::DOUBLE AS first_value FROM v")
def info_af_list_missing(spark, sf_dir):
    """A list with a missing value: an entry, but null."""
    v = variants(spark, sf_dir, info=["AF"])
    af = F.col("info_t.AF")
    return v.select("chrom", "pos", F.size(af).alias("n_values"), F.size(F.filter(af, lambda x: x.isNull())).alias("n_missing"), F.get(af, F.lit(0)).alias("first_value"))


@_query("SELECT chrom, pos::BIGINT AS pos, CASE WHEN contains(info, 'ANNO=') THEN 'a,b|%25' END AS annotation FROM v")
def info_unescape(spark, sf_dir):
    """Percent escapes undone in a list of strings."""
    v = variants(spark, sf_dir, info=["ANNO"])
    return v.select("chrom", "pos", F.array_join("info_t.ANNO", "|").alias("annotation"))


_MATE = r"""regexp_extract(a, '^([^\[\]]*)[\[\]]([^\[\]]*)[\[\]](.*)$', {})"""


@_query(f""", {_ALLELES} SELECT chrom, pos::BIGINT AS pos, a AS raw, replace(replace(split_part({_MATE.format(2)}, ':', 1), '<', ''), '>', '') AS mate_chrom,
 split_part({_MATE.format(2)}, ':', 2)::BIGINT AS mate_pos, CASE WHEN regexp_matches(a, '^[\\[\\]]') THEN '+' ELSE '-' END AS orientation,
 CASE WHEN contains(a, '[') THEN '+' ELSE '-' END AS mate_orientation,
 CASE WHEN regexp_matches(a, '^[\\[\\]]') THEN {_MATE.format(3)} ELSE {_MATE.format(1)} END AS sequence, NOT starts_with({_MATE.format(2)}, '<') AS main
 FROM t WHERE regexp_matches(a, '[\\[\\]]')""")
def breakend_fields(spark, sf_dir):
    """Parts of breakends."""
    a = samples.explode_alleles(variants(spark, sf_dir), "chrom", "pos").withColumnRenamed("allele", "a").where("a.kind = 'breakend'")
    return a.select("chrom", "pos", "a.raw", "a.mate_chrom", "a.mate_pos", "a.orientation", "a.mate_orientation", "a.sequence", F.col("a.within_main_assembly").alias("main"))


@_query(f", {_ALLELES} SELECT a AS raw, a AS text, count(*)::BIGINT AS n FROM t GROUP BY a")
def breakend_roundtrip(spark, sf_dir):
    """Alleles written anew from their parts."""
    a = samples.explode_alleles(variants(spark, sf_dir)).withColumnRenamed("allele", "a")
    return a.groupBy(F.col("a.raw").alias("raw"), alleles.serialize(F.col("a")).alias("text")).agg(F.count("*").alias("n"))


@_query(f", {_ALLELES} SELECT a AS raw, '+' AS orientation, substr(a, 2) AS sequence, count(*)::BIGINT AS n FROM t WHERE starts_with(a, '.') GROUP BY a")
def single_breakend(spark, sf_dir):
    """Breakends without mate."""
    a = samples.explode_alleles(variants(spark, sf_dir)).withColumnRenamed("allele", "a").where("a.kind = 'single_breakend'")
    return a.groupBy("a.raw", "a.orientation", "a.sequence").agg(F.count("*").alias("n"))


@_query(f", {_ALLELES} SELECT chrom, substr(a, 2, length(a) - 2) AS value, count(*)::BIGINT AS n FROM t WHERE type = 'SYMBOLIC' GROUP BY chrom, a")
def symbolic_alleles(spark, sf_dir):
    """Symbolic alleles."""
    a = samples.explode_alleles(variants(spark, sf_dir), "chrom").withColumnRenamed("allele", "a").where("a.kind = 'symbolic'")
    return a.groupBy("chrom", F.col("a.value").alias("value")).agg(F.count("*").alias("n"))


@_query(f"SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE length(ref) = 1 AND len(list_filter({_TYPES}, lambda x: x <> 'SNV')) = 0")
def is_snv_filter(spark, sf_dir):
    """Single-base changes."""
    return variants(spark, sf_dir).where(alleles.is_snv(F.col("ref"), F.col("alt"))).select("chrom", "pos", "ref")


@_query(f"""SELECT chrom, pos::BIGINT AS pos, CASE WHEN ins THEN pos ELSE pos - 1 END::BIGINT AS affected_start, CASE WHEN ins THEN pos ELSE pos - 1 + length(ref) END::BIGINT AS affected_end
 FROM (SELECT *, len({_TYPES}) > 0 AND len(list_filter({_TYPES}, lambda x: x <> 'INS')) = 0 AS ins FROM v)""")
def affected_interval(spark, sf_dir):
    """Affected places, from 0."""
    v = variants(spark, sf_dir)
    return v.select("chrom", "pos", alleles.affected_start(F.col("pos"), F.col("alt")).alias("affected_start"), alleles.affected_end(F.col("pos"), F.col("ref"), F.col("alt")).alias("affected_end"))


def _first_call(v: DataFrame) -> DataFrame:
    return v.withColumn("c", F.get("calls", F.lit(0)))


_GT = "g AS (SELECT *, nullif(split_part(s1, ':', 1), '.') AS gt FROM v), l AS (SELECT *, CASE WHEN gt IS NOT NULL THEN string_split(replace(gt, '|', '/'), '/') END AS al FROM g)"
_GTYPE = "CASE WHEN gt IS NULL OR list_contains(al, '.') THEN NULL WHEN len(list_filter(al, lambda x: x <> '0')) = 0 THEN 0 WHEN len(list_distinct(al)) = 1 THEN 2 ELSE 1 END"


@_query(f", {_GT} SELECT chrom, pos::BIGINT AS pos, array_to_string(list_transform(al, lambda x: CASE WHEN x = '.' THEN '?' ELSE x END), ',') AS alleles FROM l")
def gt_alleles(spark, sf_dir):
    """Allele numbers of the first sample."""
    v = _first_call(variants(spark, sf_dir))
    return v.select("chrom", "pos", F.array_join("c.gt_alleles", ",", "?").alias("alleles"))


@_query(f", {_GT} SELECT chrom, {_GTYPE}::INT AS gt_type, count(*)::BIGINT AS n FROM l GROUP BY 1, 2")
def gt_type_counts(spark, sf_dir):
    """Genotype classes of the first sample."""
    v = _first_call(variants(spark, sf_dir))
    return v.groupBy("chrom", genotypes.gt_type(F.col("c.gt_alleles")).cast("int").alias("gt_type")).agg(F.count("*").alias("n"))


@_query(f", {_GT} SELECT len(al)::INT AS ploidy, NOT list_contains(al, '.') AS called, count(*)::BIGINT AS n FROM l GROUP BY 1, 2")
def ploidy_counts(spark, sf_dir):
    """Ploidy and whether called."""
    v = _first_call(variants(spark, sf_dir))
    return v.groupBy(F.col("c.ploidy").alias("ploidy"), F.col("c.called").alias("called")).agg(F.count("*").alias("n"))


@_query(f", {_GT} SELECT coalesce(contains(gt, '|'), false) AS phased, CASE WHEN contains(gt, '|') THEN '|' ELSE '/' END AS phase_char, coalesce({_GTYPE} = 1, false) AS het, coalesce({_GTYPE} > 0, false) AS variant, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def phasing(spark, sf_dir):
    """Phase, heterozygosity, variants."""
    v = _first_call(variants(spark, sf_dir))
    gt, al = F.col("c.gt"), F.col("c.gt_alleles")
    return v.groupBy(genotypes.is_phased(gt).alias("phased"), genotypes.gt_phase_char(gt).alias("phase_char"), genotypes.is_het(al).alias("het"), genotypes.is_variant(al).alias("variant")).agg(F.count("*").alias("n"))


@_query(f""", {_GT} SELECT chrom, pos::BIGINT AS pos, array_to_string(list_transform(al, lambda x: CASE WHEN x = '.' THEN '?' WHEN x = '0' THEN ref
 WHEN alt = '.' THEN '?' WHEN contains(alt, '[') OR contains(alt, ']') OR starts_with(alt, '.') THEN '?' WHEN starts_with(alt, '<') THEN 'DEL' ELSE split_part(alt, ',', 1) END), ',') AS bases FROM l""")
def gt_bases(spark, sf_dir):
    """Bases of the first sample's genotype."""
    v = _first_call(variants(spark, sf_dir))
    return v.select("chrom", "pos", F.array_join(genotypes.gt_bases(F.col("ref"), F.col("alt"), F.col("c.gt_alleles")), ",", "?").alias("bases"))


@_query("SELECT chrom, pos::BIGINT AS pos, contains(s2, 'q10') AS by_default, contains(s2, 'q10') AS required, false AS none_left, contains(s2, 'PASS') AS pass_counts FROM v")
def call_is_filtered(spark, sf_dir):
    """Whether calls are filtered, by default, with required and with ignored filters."""
    v = variants(spark, sf_dir).withColumn("ft", F.get("calls", F.lit(1))["ft"])
    ft = F.col("ft")
    return v.select("chrom", "pos", genotypes.is_filtered(ft).alias("by_default"), genotypes.is_filtered(ft, require=["q10"]).alias("required"), genotypes.is_filtered(ft, ignore=["q10", "s50", "PASS"]).alias("none_left"), genotypes.is_filtered(ft, ignore=["q10", "s50"]).alias("pass_counts"))


@_query("SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE chrom = 'chr3' AND pos <= 30000 AND pos + length(ref) - 1 >= 1000")
def region_closed(spark, sf_dir):
    """Records that overlap a region."""
    return region.fetch(variants(spark, sf_dir), "chr3:1,000-30,000").select("chrom", "pos", "ref")


@_query("SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE chrom = 'chr4' AND pos + length(ref) - 1 >= 20000")
def region_open_end(spark, sf_dir):
    """Records from a place on."""
    return region.fetch(variants(spark, sf_dir), "chr4:20000").select("chrom", "pos", "ref")


@_query("SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE chrom = 'chr22'")
def region_chrom(spark, sf_dir):
    """Records of a sequence."""
    return region.fetch(variants(spark, sf_dir), chrom="chr22").select("chrom", "pos", "ref")


@_query("""SELECT chrom, pos::BIGINT AS pos, ('4681' || '')::BIGINT + ((pos - 1) >> 14) + CASE WHEN ((pos - 1) >> 14) < ((pos + length(ref) - 2) >> 14) THEN 1 ELSE 0 END AS first_bin,
 (6 + CASE WHEN ((pos - 1) >> 14) < ((pos + length(ref) - 2) >> 14) THEN 1 ELSE 0 END + CASE WHEN ((pos - 1) >> 17) < ((pos + length(ref) - 2) >> 17) THEN 1 ELSE 0 END
  + CASE WHEN ((pos - 1) >> 20) < ((pos + length(ref) - 2) >> 20) THEN 1 ELSE 0 END)::INT AS n_bins FROM v""")
def region_bins(spark, sf_dir):
    """Bins that records may be filed under."""
    v = variants(spark, sf_dir)
    b = bins.region_bins_column(F.col("begin"), F.col("begin") + F.length("ref"))
    return v.select("chrom", "pos", F.get(b, F.lit(0)).alias("first_bin"), F.size(b).alias("n_bins"))


@_query("""SELECT 'r' || n_nationkey::VARCHAR AS region_id, chrom, pos::BIGINT AS pos FROM v JOIN nation
 ON chrom = 'chr' || (n_nationkey % 22 + 1)::VARCHAR AND pos <= n_nationkey * 5000 + 9000 AND pos + length(ref) - 1 >= n_nationkey * 5000 + 1""")
def region_batch_join(spark, sf_dir):
    """Many regions at once."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    asked = n.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("region_id"), F.concat(F.lit("chr"), (F.col("n_nationkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("n_nationkey") * 5000 + 1).alias("start"), (F.col("n_nationkey") * 5000 + 9000).alias("end"))
    return region.fetch_many(variants(spark, sf_dir), asked).select("region_id", "chrom", "pos")


_DEPTH = "(split_part(s1, ':', 2)::INT + CASE WHEN s2 = '0/0' THEN 0 ELSE split_part(s2, ':', 2)::INT END)"


@_query(f"SELECT chrom, pos::BIGINT AS pos, CASE WHEN {_DEPTH} >= 20 THEN CASE WHEN filter = '.' THEN '' ELSE filter END WHEN filter IN ('.', 'PASS') THEN 'DP20' ELSE filter || ';DP20' END AS filters FROM v")
def soft_filter_dp(spark, sf_dir):
    """A soft filter on total depth."""
    v = edit.soft_filter_total_depth(variants(spark, sf_dir), 20, "DP20")
    return v.select("chrom", "pos", F.array_join("filter", ";").alias("filters"))


@_query("SELECT chrom, pos::BIGINT AS pos, 'GT:DP:FT:GQ' AS format, CASE WHEN s2 = '0/0' THEN '0/0:.:.' ELSE s2 END || ':30' AS second FROM v")
def add_format_default(spark, sf_dir):
    """A FORMAT key with a value for all calls."""
    v = edit.add_format(edit.add_format(variants(spark, sf_dir), "GQ", "30"), "DP", "99")
    return v.select("chrom", "pos", F.array_join("format", ":").alias("format"), render.call_text(F.col("format"), F.get("calls", F.lit(1))).alias("second"))


@_query("SELECT chrom, pos::BIGINT AS pos, '1|2' AS gt, 2::INT AS ploidy, 1::INT AS gt_type FROM v")
def set_genotype(spark, sf_dir):
    """A genotype set anew; what follows from it is too."""
    v = edit.set_genotype(variants(spark, sf_dir), F.lit("1|2"), "s1").withColumn("c", F.get("calls", F.lit(0)))
    return v.select("chrom", "pos", "c.gt", "c.ploidy", genotypes.gt_type(F.col("c.gt_alleles")).cast("int").alias("gt_type"))


@_query("SELECT chrom, pos::BIGINT AS pos, 's50' AS filter FROM v WHERE filter = 'q10;s50'")
def unknown_filters(spark, sf_dir):
    """Filters that the header does not declare."""
    v = variants(spark, sf_dir)
    return v.select("chrom", "pos", F.explode(check.unknown_filters(F.col("filter"), header())).alias("filter"))


@_query("SELECT chrom, count(*)::BIGINT AS n FROM v WHERE CASE WHEN alt = '.' THEN 0 ELSE len(string_split(alt, ',')) END <> 2 GROUP BY chrom")
def info_length_check(spark, sf_dir):
    """Records whose list is too long or short."""
    v = variants(spark, sf_dir, checks=["INFO"])
    bad = F.exists("warnings", lambda w: w["code"] == "IncorrectListLength")
    return v.select("chrom", bad.alias("bad")).groupBy("chrom").agg(F.count_if("bad").alias("n")).where("n > 0")


@_query("SELECT chrom, pos::BIGINT AS pos, NULL::BIGINT AS ns, 'x7' AS raw, 1::INT AS n_warnings FROM v WHERE contains(info, 'NS=')")
def conversion_warnings(spark, sf_dir):
    """Values that do not convert: null, with their text and a warning kept."""
    v = variants(spark, sf_dir).where(F.map_contains_key("info", "NS"))
    return v.select("chrom", "pos", F.col("info_t.NS").alias("ns"), F.col("info")["NS"].alias("raw"), F.size(F.filter("warnings", lambda w: w["code"] == "CannotConvertValue")).alias("n_warnings"))


@_query("SELECT chrom, pos::BIGINT AS pos, pos % 2 = 0 AS bad FROM v")
def arity_check(spark, sf_dir):
    """Lines of wrong length, kept beside the others."""
    cut = lines(spark, sf_dir).select(F.when(F.expr("CAST(split(value, '\\t')[1] AS BIGINT) % 2 = 0"), F.concat("value", F.lit("\tx"))).otherwise(F.col("value")).alias("value"))
    v = parse_records(cut, header(), mode="permissive")
    return v.select(F.split("line", "\t")[0].alias("chrom"), F.split("line", "\t")[1].cast("bigint").alias("pos"), F.col("error").isNotNull().alias("bad"))


@_query("SELECT chrom, pos::BIGINT AS pos, true AS parsed, false AS other_parsed, s1 AS other_raw FROM v")
def sample_subset(spark, sf_dir):
    """Only one sample's calls parsed; the other keeps its text."""
    h = header()
    h.samples = SamplesInfos(h.samples.names, ["s2"])
    v = parse_records(lines(spark, sf_dir), h)
    a, b = F.get("calls", F.lit(0)), F.get("calls", F.lit(1))
    return v.select("chrom", "pos", b["parsed"].alias("parsed"), a["parsed"].alias("other_parsed"), a["raw"].alias("other_raw"))


@_query("SELECT chrom || chr(9) || pos::VARCHAR || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || filter || chr(9) || info || chr(9) || 'GT:DP:FT' || chr(9) || CASE WHEN s2 = '0/0' THEN '0/0:.:.' ELSE s2 END || chr(9) || s1 AS line FROM v")
def sample_reorder(spark, sf_dir):
    """Lines with the samples in another order."""
    v, h = samples.select_samples(variants(spark, sf_dir), header(), ["s2", "s1"])
    return v.select(render.record_line(h).alias("line"))


@_query("SELECT chrom, pos::BIGINT AS pos, 's1' AS sample, nullif(split_part(s1, ':', 1), '.') AS gt, split_part(s1, ':', 2)::BIGINT AS depth FROM v UNION ALL SELECT chrom, pos, 's2', split_part(s2, ':', 1), nullif(split_part(s2, ':', 2), '')::BIGINT FROM v")
def calls_long(spark, sf_dir):
    """One row for each record and sample."""
    return samples.calls_long(variants(spark, sf_dir), header(), ["DP"]).select("chrom", "pos", "sample", "gt", F.col("DP").alias("depth"))


_WRITTEN = "chrom || chr(9) || pos::VARCHAR || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || filter || chr(9) || {} || chr(9) || 'GT:DP:FT' || chr(9) || s1 || chr(9) || CASE WHEN s2 = '0/0' THEN '0/0:.:.' ELSE s2 END"


@_query(f"SELECT {_WRITTEN.format('info')} AS line FROM v")
def parse_render_roundtrip(spark, sf_dir):
    """Records written as they were read; missing call values as dots."""
    return variants(spark, sf_dir).select(render.record_line(header()).alias("line"))


@_query(f"SELECT {_WRITTEN.format(chr(39).join(['info || ', ';NOTE=a%3Bb%3Dc%25', '']))} AS line FROM v")
def render_escape(spark, sf_dir):
    """An INFO value with reserved characters, written escaped."""
    return edit.set_info(variants(spark, sf_dir), "NOTE", F.lit("a;b=c%")).select(render.record_line(header()).alias("line"))


@_query(f", {_GT} SELECT chrom, pos::BIGINT AS pos, ref, CASE WHEN alt = '.' THEN '' ELSE alt END AS alt, coalesce(gt, './.') AS s1, split_part(s2, ':', 1) AS s2 FROM l WHERE length(ref) = 1 AND len(list_filter({_TYPES}, lambda x: x <> 'SNV')) = 0")
def snv_tsv(spark, sf_dir):
    """Genotypes of single-base changes as a table."""
    return write.snv_table(variants(spark, sf_dir), header())


_HEADER_ROWS = "(VALUES (0, 'fileformat', NULL, 'VCFv4.3'), (1, 'FILTER', 'q10', 'a'), (2, 'FILTER', 'q10', 'b'), (3, 'INFO', 'DP', 'c'), (4, 'FORMAT', 'DP', 'd'), (5, 'INFO', 'DP', 'e'), (6, 'source', NULL, 'x'), (7, 'source', NULL, 'x')) AS h(idx, key, id, value)"


def _header_rows(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT idx, key, CAST(id AS STRING) AS id, value FROM {_HEADER_ROWS}")


@_query(f"SELECT idx::INT AS idx, key, id, value FROM {_HEADER_ROWS} WHERE idx NOT IN (2, 5)")
def header_dedupe(spark, sf_dir):
    """The first of duplicate header lines counts."""
    return headers.first_of_each(_header_rows(spark))


@_query(f"SELECT idx::INT AS idx, key, id, value FROM {_HEADER_ROWS} WHERE NOT (key = 'FILTER' AND id = 'q10') AND NOT (key = 'source' AND value = 'x')")
def header_without_lines(spark, sf_dir):
    """Header lines without some."""
    gone = spark.createDataFrame([("FILTER", "q10"), ("source", "x")], "key string, id string")
    return headers.without_lines(_header_rows(spark), gone)


@_query("""SELECT * FROM (VALUES ('INFO', 'AF', 'Float', 'A', 'declared'), ('INFO', 'CIPOS', 'Integer', '2', 'reserved'), ('INFO', 'NEW', 'String', '.', 'default'),
 ('FORMAT', 'GT', 'String', '1', 'declared'), ('FORMAT', 'PL', 'Integer', 'G', 'reserved'), ('FORMAT', 'NEW', 'String', '.', 'default')) AS f(kind, key, type, number, source)""")
def field_info_resolution(spark, sf_dir):
    """Types of fields: declared, reserved, assumed."""
    h = header()
    declared = spark.createDataFrame([(x.key, x.id, x.type, str(x.number)) for x in h.lines if x.key in ("INFO", "FORMAT")], "kind string, key string, type string, number string")
    keys = spark.createDataFrame([("INFO", "AF"), ("INFO", "CIPOS"), ("INFO", "NEW"), ("FORMAT", "GT"), ("FORMAT", "PL"), ("FORMAT", "NEW")], "kind string, key string")
    return headers.resolve_fields(keys, declared, headers.reserved_fields(spark))


@_query("SELECT pos::BIGINT AS block, (pos % 65536)::BIGINT AS within, ((pos << 16) | (pos % 65536))::BIGINT AS voffset FROM v")
def virtual_offset(spark, sf_dir):
    """Virtual offsets, packed and taken apart."""
    v = variants(spark, sf_dir).select(bins.virtual_offset(F.col("pos"), F.col("pos") % 65536).alias("voffset"))
    return v.select(bins.block_start(F.col("voffset")).alias("block"), bins.within_block(F.col("voffset")).alias("within"), "voffset")


@_query("SELECT code, message, count(*)::BIGINT AS n FROM (SELECT 'UnknownFilter' AS code, 'FILTER holds s50, which the header does not declare' AS message FROM v WHERE filter = 'q10;s50' UNION ALL SELECT 'UnknownFilter', 'FORMAT/FT holds s50, which the header does not declare' FROM v WHERE contains(s2, 's50') UNION ALL SELECT 'CannotConvertValue', 'NS: x7 is no Integer, its text is kept' FROM v WHERE contains(info, 'NS=')) GROUP BY code, message")
def warning_summary(spark, sf_dir):
    """All warnings, counted."""
    return check.warning_summary(variants(spark, sf_dir))


def _scratch(spark: SparkSession) -> str:
    """A folder for files of a query: the shared one where the session names one, else (on one machine) a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="helixframe-")
    return f"{base}/{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str, **options) -> str:
    """A sorted block-gzip file of all records, in the shared folder."""
    path = f"{_scratch(spark)}/variants.vcf.gz"
    write.write_vcf(variants(spark, sf_dir), header(), path, order=["chrom", "pos"], **options)
    return path


@_query("SELECT chrom, count(*)::BIGINT AS n, sum(pos)::BIGINT AS places FROM v GROUP BY chrom")
def bgzf_file_scan(spark, sf_dir):
    """A block-gzip file written, split by block and read back."""
    path = _written(spark, sf_dir)
    v = parse_records(read.read_lines(spark, path), read.read_header(spark, path))
    return v.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("places"))


@_query("SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE chrom = 'chr3' AND pos <= 30000 AND pos + length(ref) - 1 >= 1000")
def indexed_fetch(spark, sf_dir):
    """A region read through an index: only the chunks it names."""
    from .sources import tabix

    path = _written(spark, sf_dir)
    reader = read.Reader.from_path(spark, path, tabix_path=tabix.write_index(path, f"{path}.index", spark))
    return reader.fetch("chr3", 1000, 30000).select("chrom", "pos", "ref")


@_query("SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE chrom = 'chr5' AND pos + length(ref) - 1 >= 40000")
def fetch_auto_index(spark, sf_dir):
    """A region to the end of a sequence, through the index that was written with the file and lies beside it."""
    reader = read.Reader.from_path(spark, _written(spark, sf_dir, index=True))
    return reader.fetch("chr5:40,000").select("chrom", "pos", "ref")


@_query("SELECT chrom, count(*)::BIGINT AS n, sum(pos)::BIGINT AS places FROM v GROUP BY chrom")
def stream_counts(spark, sf_dir):
    """Lines that arrive as a stream, parsed without state."""
    base = _scratch(spark)
    lines(spark, sf_dir).write.text(f"{base}/in")
    stream = read_stream(spark, f"{base}/in", header()).select("chrom", "pos")
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    v = spark.read.schema("chrom string, pos bigint").parquet(f"{base}/out")
    return v.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("places"))


# They register theirs too.
from . import catalog_files, catalog_headers  # noqa: E402, F401
