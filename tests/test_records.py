import pytest
from pyspark.sql import functions as F

from helixframe.functions import alleles, bins, fields, genotypes
from helixframe.operators import edit, render, samples
from helixframe.plans.header import parse_header
from helixframe.sources import read

HEAD = """##fileformat=VCFv4.3
##FILTER=<ID=q10,Description="x">
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="d">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##INFO=<ID=ANNO,Number=.,Type=String,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="d">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
##FORMAT=<ID=HQ,Number=2,Type=Integer,Description="d">
##FORMAT=<ID=FT,Number=1,Type=String,Description="d">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	A	B
""".splitlines()


def row(line, spark, **options):
    return read.from_lines(spark, [*HEAD, line], **options).first()


def record(spark, **kw):
    base = {"chrom": "20", "pos": "100", "id": ".", "ref": "A", "alt": "T", "qual": ".", "filter": ".", "info": ".", "format": "GT", "a": "0/1", "b": "./."} | kw
    return row("\t".join(base.values()), spark)


TYPES = [("C", "T", "SNV"), ("GC", "TG", "MNV"), ("C", "CT", "INS"), ("CT", "C", "DEL"), ("AAAC", "TG", "INDEL"), ("A", "CT", "INDEL"), ("AAAC", "AA", "INDEL"), ("AT", "ATT", "INDEL"), ("T", "*", "SNV"), ("A", "<DUP>", "SYMBOLIC"), ("G", "G]17:198982]", "BND"), ("G", ".A", "BND"), ("G", "A.", "BND")]
ENDS = [("G]17:198982]", ("17", 198982, "-", "-", "G", True)), ("]13:123456]AGTNNNNNCAT", ("13", 123456, "+", "-", "AGTNNNNNCAT", True)), (".[13:123457[", ("13", 123457, "-", "+", ".", True)), ("A[<chr2>:12345[", ("chr2", 12345, "-", "+", "A", False)), ("[17:198983[A", ("17", 198983, "+", "+", "A", True)), (".A", (None, None, "+", None, "A", None)), ("A.", (None, None, "-", None, "A", None))]


def test_allele_types(spark):
    rows = spark.createDataFrame(TYPES, "ref string, alt string, type string").select("type", alleles.allele(F.col("ref"), F.col("alt")).alias("a")).collect()
    assert [r.a.type for r in rows] == [r.type for r in rows]


def test_breakends(spark):
    frame = spark.createDataFrame([(x,) for x, _ in ENDS], "alt string").withColumn("a", alleles.allele(F.lit("G"), F.col("alt")))
    for r, (text, parts) in zip(frame.select("a", alleles.serialize(F.col("a")).alias("t")).collect(), ENDS, strict=True):
        assert (r.a.mate_chrom, r.a.mate_pos, r.a.orientation, r.a.mate_orientation, r.a.sequence, r.a.within_main_assembly) == parts
        assert r.t == text


def test_fixed_fields(spark):
    r = record(spark, id="rs1;rs2", alt="T,.", qual="6162.770", filter="PASS;x")
    assert (r.chrom, r.pos, r.begin, r.id, r.qual, r.qual_raw, r.filter) == ("20", 100, 99, ["rs1", "rs2"], 6162.77, "6162.770", ["PASS", "x"])
    assert [a.kind for a in r.alt] == ["substitution", "single_breakend"]
    assert [w.code for w in r.warnings] == ["UnknownFilter"]
    r = record(spark, alt=".", ref="A")
    assert r.id == [] and r.alt == [] and r.qual is None and r.filter == [] and r.info == {}


def test_info(spark):
    r = record(spark, alt="T,C", info="DP=12.0;AF=0.5,.;DB;ANNO=Here%2Care%25some chars,%2525;NEW=1;DP=3")
    assert (r.info_t.DP, r.info_t.AF, r.info_t.DB, r.info_t.ANNO) == (3, [0.5, None], True, ["Here,are%some chars", "%25"])
    assert set(r.info) == {"DP", "AF", "DB", "ANNO", "NEW"} and r.info["DB"] is None
    keys = spark.range(1).select(F.map_keys(fields.info_map(F.lit("DP=1;AF=2;DB;NEW=1;DP=3"))).alias("k")).first().k
    assert keys == ["DP", "AF", "DB", "NEW"]
    r = record(spark, info="DP=12.0;AF=.")
    assert r.info_t.DP is None and r.info["DP"] == "12.0" and r.info_t.AF == [] and r.info_t.DB is False and r.info_t.ANNO is None
    assert [w.code for w in r.warnings] == ["CannotConvertValue"]
    for text, value in (("+5", 5), ("1_000", None), ("3,4", None), (".", None)):
        assert record(spark, info=f"DP={text}").info_t.DP == value


@pytest.mark.parametrize("text, value", [("1.5f", None), ("1d", None), ("inf", float("inf")), ("1e-3", 0.001), (".5", 0.5), ("5.", 5.0), ("x", None)])
def test_floats(spark, text, value):
    assert spark.range(1).select(fields.number(F.lit(text), "Float").alias("v")).first().v == value


def test_calls(spark):
    r = record(spark, format="GT:DP:HQ:FT", a="0|1:7:1,.:q10;zz", b="0/0")
    a, b = r.calls
    assert (a.sample, a.gt, a.gt_alleles, a.called, a.ploidy, a.ft) == ("A", "0|1", [0, 1], True, 2, ["q10", "zz"])
    assert b.data == {"GT": "0/0"} and b.ft is None
    assert [w.message for w in r.warnings] == ["FORMAT/FT holds zz, which the header does not declare"]
    assert record(spark, format="GT", a="0/0:25").calls[0].data == {"GT": "0/0"}
    c = record(spark, a=".", b="./1").calls
    assert c[0].gt is None and c[0].ploidy is None and c[1].gt_alleles == [None, 1] and c[1].called is False


def test_long_calls(spark):
    h = parse_header(HEAD)
    v = read.from_lines(spark, [*HEAD, "1\t5\t.\tA\tC\t.\t.\t.\tGT:HQ\t0/1:3,.\t1"])
    assert [(r.sample, r.gt, r.HQ) for r in samples.calls_long(v, h, ["HQ"]).collect()] == [("A", "0/1", [3, None]), ("B", "1", None)]


GENOTYPES = [("0/0", 0, False, False, False), ("0/1", 1, True, True, False), ("1/1", 2, False, True, False), ("1|2", 1, True, True, True), ("./.", None, False, False, False), ("0/.", None, False, False, False), ("1", 2, False, True, False), (None, None, False, False, False), ("0/1|2", 1, True, True, True)]


def test_genotypes(spark):
    al = genotypes.gt_alleles(F.col("gt"))
    frame = spark.createDataFrame([(g,) for g, *_ in GENOTYPES], "gt string")
    rows = frame.select("gt", genotypes.gt_type(al), genotypes.is_het(al), genotypes.is_variant(al), genotypes.is_phased(F.col("gt"))).collect()
    assert [tuple(r) for r in rows] == GENOTYPES


def test_is_filtered(spark):
    f = lambda ft, **kw: spark.createDataFrame([(ft,)], "ft array<string>").select(genotypes.is_filtered(F.col("ft"), **kw)).first()[0]
    assert [f(None), f([]), f(["PASS"]), f(["q10"]), f(["PASS", "q10"])] == [False, False, False, True, True]
    assert f(["q10"], require=["s50"]) is False and f(["q10"], require=["q10"]) is True
    assert f(["q10"], ignore=["q10"]) is False and f(["PASS"], ignore=["q10"]) is True and f(["PASS"], ignore=[]) is False


def test_affected(spark):
    cases = [("A", "T", 1233, 1234), ("ATG", "A", 1233, 1236), ("A", "AT", 1234, 1234), ("A", "AT,C", 1233, 1234)]
    frame = spark.createDataFrame(cases, "ref string, alt string, s long, e long").withColumn("a", alleles.alleles(F.col("ref"), F.col("alt"))).withColumn("pos", F.lit(1234))
    rows = frame.select("s", "e", alleles.affected_start(F.col("pos"), F.col("a")).alias("x"), alleles.affected_end(F.col("pos"), F.col("ref"), F.col("a")).alias("y")).collect()
    assert all((r.s, r.e) == (r.x, r.y) for r in rows)


def test_escapes(spark):
    text = "a;b=c%d,e\r\n\tf:g"
    r = spark.createDataFrame([(text, "x:y", "p;q")], "a string, b string, c string").select(
        fields.escape_info(F.col("a")).alias("info"), fields.unescape(fields.escape_info(F.col("a"))).alias("back"), fields.escape_info(F.col("b")).alias("colon"), fields.escape_format(F.col("b")).alias("f"), fields.escape_format(F.col("c")).alias("semicolon")
    ).first()
    assert r.info == "a%3Bb%3Dc%25d%2Ce%0D%0A%09f%3Ag"
    assert r.back == text and r.colon == "x:y" and r.f == "x%3Ay" and r.semicolon == "p;q"
    un = lambda s: spark.createDataFrame([(s,)], "s string").select(fields.unescape(F.col("s"))).first()[0]
    assert un("%253A") == ":" and un("%2525") == "%25" and un("%3a") == "%3a" and un("a+b") == "a+b"


def test_filters(spark):
    v = read.from_lines(spark, [*HEAD, "1\t5\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t1", "1\t6\t.\tA\tC\t.\tx\t.\tGT\t0/1\t1", "1\t7\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1"])
    assert [r.filter for r in edit.add_filter(v, "x").orderBy("pos").collect()] == [["x"], ["x"], ["x"]]
    assert [r.filter for r in edit.add_filter(v, "y", F.col("pos") > 5).orderBy("pos").collect()] == [["PASS"], ["x", "y"], ["y"]]


def test_edits(spark):
    h = parse_header(HEAD)
    v = read.from_lines(spark, [*HEAD, "1\t5\t.\tA\tC\t.\t.\tDP=1;DB\tGT\t0/1\t1"])
    e = edit.set_info(edit.set_info(edit.set_info(v, "DP", F.lit(7)), "AF", F.array(F.lit(0.0001), F.lit(12345678.0))), "NEW", None)
    e = edit.set_call_value(edit.add_format(e, "DP", "3"), "HQ", F.array(F.lit(1), F.lit(None).cast("int")), "B")
    assert e.select(render.record_line(h)).first()[0] == "1\t5\t.\tA\tC\t.\t.\tDP=7;DB;AF=0.0001,12345678.0;NEW\tGT:DP:HQ\t0/1:3:.\t1:3:1,."
    assert edit.drop_info(v, "DP").select(render.record_line(h)).first()[0].split("\t")[7] == "DB"


def test_edits_leave_other_columns_alone(spark):
    v = read.from_lines(spark, [*HEAD, "1\t5\t.\tA\tC\t.\t.\tDP=1\tGT\t0/1\t1"]).withColumn("_text", F.lit("mine")).withColumn("text", F.lit("too"))
    e = edit.set_call_value(edit.set_info(v, "DP", F.lit(7)), "DP", F.lit(3))
    assert e.columns == v.columns
    r = e.first()
    assert (r._text, r.text, r.info["DP"]) == ("mine", "too", "7") and [c.data["DP"] for c in r.calls] == ["3", "3"]


def test_unparsed(spark):
    h = parse_header(HEAD, ["B"])
    v = read.from_lines(spark, ["1\t5\t.\tA\tC\t.\t.\t.\tGT:DP\t0/1:9\t1"], h)
    r = edit.add_format(v, "GQ", "1").first()
    assert r.calls[0].raw == "0/1:9" and not r.calls[0].parsed and [w.code for w in r.warnings] == ["CannotModifyUnparsedCallWarning"]
    assert v.select(render.record_line(h)).first()[0].endswith("GT:DP\t0/1:9\t1:.")


def test_modes(spark):
    bad = ["1\t5\t.\tA\tC", "1\tx\t.\tA\tC\t.\t.\t.\tGT\t0\t1", "", "1\t5\t.\tA\tC\t.\t.\t.\tGT\t0\t1"]
    rows = read.from_lines(spark, [*HEAD, *bad], mode="permissive").collect()
    assert [r.error is None for r in rows] == [False, False, True]
    assert "the line has 5 columns, not 11" in rows[0].error
    assert read.from_lines(spark, [*HEAD, *bad], mode="dropmalformed").count() == 1
    with pytest.raises(Exception, match="columns, not"):
        read.from_lines(spark, [*HEAD, *bad]).collect()


def test_list_checks(spark):
    r = row("1\t5\t.\tA\tC,G\t.\t.\tAF=1.0\tGT:HQ\t0:1,2,3\t1", spark, checks=["INFO", "FORMAT"])
    assert [w.message for w in r.warnings] == ["INFO AF has 1 values, not 2", "FORMAT HQ has 3 values, not 2"]


def test_no_samples(spark):
    head = [*HEAD[:-1], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    line = "1\t5\t.\tA\tC\t.\t.\tDP=1"
    v = read.from_lines(spark, [*head, line])
    r = v.first()
    assert r.calls == [] and r.format == [] and v.select(render.record_line(parse_header(head))).first()[0] == line


def test_samples_selected(spark):
    h = parse_header(HEAD)
    v, h2 = samples.select_samples(read.from_lines(spark, [*HEAD, "1\t5\t.\tA\tC\t.\t.\t.\tGT\t0\t1"]), h, ["B"])
    assert h2.column_line().endswith("FORMAT\tB") and v.select(render.record_line(h2)).first()[0].endswith("GT\t1")
    with pytest.raises(KeyError):
        samples.select_samples(v, h, ["Z"])


def test_bins(spark):
    assert bins.make_virtual_offset(100000, 10) == 6553600010 and bins.split_virtual_offset(65537) == (1, 1)
    for bad in ((0, 65536), (1 << 48, 0), (-1, 0)):
        with pytest.raises(ValueError):
            bins.make_virtual_offset(*bad)
    for b, e in ((0, 1), (100, 20000), (1 << 26, (1 << 26) + 5), (0, 1 << 29)):
        got = spark.range(1).select(bins.region_bins_column(F.lit(b).cast("long"), F.lit(e).cast("long"))).first()[0]
        assert got == bins.region_bins(b, e) and got[-1] == 0
    assert [bins.binomial(5, 2), bins.binomial(4, 0), bins.binomial(-1, 2)] == [10, 1, 0]
