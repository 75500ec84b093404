"""Registered queries of files, regions and plain objects, and the same results as SQL."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _WRITTEN, _query, _scratch, _written, header, variants
from .operators import region
from .plans.header import parse_header
from .plans.variants import parse_records
from .records import Allele, Call, Record
from .sources import read, tabix, write

_COUNTS = "SELECT chrom, count(*)::BIGINT AS n, sum(pos)::BIGINT AS places FROM v GROUP BY chrom"


def _counts(v: DataFrame) -> DataFrame:
    return v.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("places"))


@_query(_COUNTS)
def plain_file_scan(spark, sf_dir):
    """A plain file, written and read back through a reader."""
    path = f"{_scratch(spark)}/variants.vcf"
    with write.Writer.from_path(path, header()) as out:
        out.write(variants(spark, sf_dir), order=["chrom", "pos"])
    with read.Reader.from_path(spark, path) as reader:
        return _counts(reader.variants())


@_query(_COUNTS)
def part_files_scan(spark, sf_dir):
    """Text parts with the header beside them."""
    path = f"{_scratch(spark)}/parts"
    write.write_parts(variants(spark, sf_dir), header(), path)
    lines = spark.read.text(path)
    head = parse_header(r.value for r in spark.read.text(f"{path}.header").collect())
    return _counts(parse_records(lines, head))


@_query("SELECT id, count(*)::BIGINT AS n FROM (SELECT 'é' || chrom || 'ß' AS id FROM v) GROUP BY id")
def latin1_scan(spark, sf_dir):
    """A block-gzip file in an encoding of one byte a character."""
    path = f"{_scratch(spark)}/latin.vcf.gz"
    v = variants(spark, sf_dir).withColumn("id", F.array(F.concat(F.lit("é"), "chrom", F.lit("ß"))))
    write.write_vcf(v, header(), path, order=["chrom", "pos"], encoding="iso-8859-1")
    return read.read_vcf(spark, path, encoding="iso-8859-1").groupBy(F.get("id", F.lit(0)).alias("id")).agg(F.count("*").alias("n"))


@_query("SELECT chrom, count(*)::BIGINT AS n, 0::BIGINT AS inversions, row_number() OVER (ORDER BY chrom <> 'chr1', chrom)::BIGINT AS place FROM v GROUP BY chrom")
def written_order(spark, sf_dir):
    """Records sorted by the header's sequences and place, as the file has them."""
    from pyspark.sql import Window

    path = f"{_scratch(spark)}/sorted.vcf.gz"
    write.write_vcf(variants(spark, sf_dir), header(), path, order=write.contig_order(header()))
    v = read.read_vcf(spark, path, info=[]).select("chrom", "pos", "line_no")
    before = F.lag("pos").over(Window.partitionBy("chrom").orderBy("line_no"))
    by = v.withColumn("before", before).groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("pos")).alias("inversions"), F.min("line_no").alias("first"))
    # One row for each sequence.
    return by.select("chrom", "n", "inversions", F.row_number().over(Window.orderBy("first")).cast("bigint").alias("place"))


@_query(f"SELECT {_WRITTEN.format('info')} AS value FROM v WHERE chrom = 'chr7' AND pos <= 60000 AND pos + length(ref) - 1 >= 5000")
def tabix_file_lines(spark, sf_dir):
    """Lines of a region by the file object of an index."""
    with tabix.TabixFile(spark, _written(spark, sf_dir, index=True)) as f:
        return f.fetch(region="chr7:5,000-60,000").select("value")


@_query("""SELECT 'r' || n_nationkey::VARCHAR AS region_id, chrom, pos::BIGINT AS pos FROM v JOIN nation
 ON chrom = 'chr' || (n_nationkey % 22 + 1)::VARCHAR
 AND CASE n_nationkey % 4 WHEN 0 THEN pos <= n_nationkey * 5000 + 9000 AND pos + length(ref) - 1 >= n_nationkey * 5000 + 1
  WHEN 1 THEN pos + length(ref) - 1 >= n_nationkey * 5000 + 1 WHEN 2 THEN pos <= n_nationkey * 5000 + 9000 ELSE true END""")
def region_batch_open_end(spark, sf_dir):
    """Many regions at once: closed, to the end, from the start, and whole sequences."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    asked = n.select(
        F.concat(F.lit("r"), k.cast("string")).alias("region_id"), F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"),
        F.when(k % 4 < 2, k * 5000 + 1).alias("start"), F.when(k % 2 == 0, k * 5000 + 9000).alias("end"),
    )
    return region.fetch_many(variants(spark, sf_dir), asked).select("region_id", "chrom", "pos")


@_query("SELECT chrom, pos::BIGINT AS pos, ref FROM v WHERE chrom = 'chr9'")
def fetch_plain_file(spark, sf_dir):
    """A region of a file without index: a scan."""
    path = f"{_scratch(spark)}/variants.vcf"
    write.write_vcf(variants(spark, sf_dir), header(), path)
    return read.Reader.from_path(spark, path).fetch("chr9").select("chrom", "pos", "ref")


def _objects(spark: SparkSession, sf_dir: str) -> list[Record]:
    """One record for each nation, made by hand."""
    out = []
    for r in sorted(spark.read.parquet(f"{sf_dir}/nation.parquet").collect()):
        calls = [Call("s1", {"GT": "0/1", "DP": r.n_nationkey}), Call("s2", {"GT": "1|1", "DP": None})]
        allele = Allele("substitution", "SNV", "T")
        out.append(Record(f"chr{r.n_regionkey + 1}", r.n_nationkey * 10 + 1, [r.n_name], "A", [allele], 30, ["PASS"], {"DP": r.n_nationkey, "AF": [0.5], "DB": True}, ["GT", "DP"], calls))
    return out


@_query("""SELECT 'chr' || (n_regionkey + 1)::VARCHAR AS chrom, (n_nationkey * 10 + 1)::BIGINT AS pos, n_name AS id, n_nationkey::BIGINT AS depth, 1::INT AS gt_type, true AS known, true AS equal FROM nation""")
def objects_round_trip(spark, sf_dir):
    """Records made as objects, written to a stream one by one, and read back from it as a frame and as equal objects."""
    from .functions import genotypes
    from .records import stream

    made, text = _objects(spark, sf_dir), _Kept()
    with write.Writer.from_stream(text, header()) as out:
        for r in made:
            out.write_record(r)
    reader = read.Reader.from_stream(spark, io.StringIO(text.text))
    v = reader.variants()
    equal = {(r.chrom, r.pos) for r, m in zip(sorted(stream(v, header()), key=lambda r: r.pos), made, strict=True) if r == m}
    known = spark.createDataFrame(sorted(equal), "chrom string, pos bigint").withColumn("equal", F.lit(True))
    c = F.get("calls", F.lit(0))
    rows = v.select("chrom", "pos", F.get("id", F.lit(0)).alias("id"), F.col("info_t.DP").alias("depth"), genotypes.gt_type(c["gt_alleles"]).cast("int").alias("gt_type"), F.col("info_t.DB").alias("known"))
    return rows.join(known, ["chrom", "pos"], "left").withColumn("equal", F.coalesce("equal", F.lit(False)))


class _Kept(io.StringIO):
    """Text that is still there after the stream is closed."""

    text = ""

    def close(self):
        if not self.closed:
            self.text = self.getvalue()
        super().close()


@_query("SELECT ('chr' || (n_regionkey + 1)::VARCHAR) AS chrom, count(*)::BIGINT AS n, sum(n_nationkey * 10 + 1)::BIGINT AS places FROM nation GROUP BY 1")
def objects_to_block_gzip(spark, sf_dir):
    """Objects written to a block-gzip file, which then is indexed and read."""
    path = f"{_scratch(spark)}/objects.vcf.gz"
    with write.Writer.from_path(path, header()) as out:
        for r in sorted(_objects(spark, sf_dir), key=lambda r: (r.chrom, r.pos)):
            out.write_record(r)
    tabix.write_index(path, spark=spark)
    parts = [read.Reader.from_path(spark, path).fetch(f"chr{i}") for i in range(1, 6)]
    v = parts[0]
    for p in parts[1:]:
        v = v.unionByName(p)
    return _counts(v)
