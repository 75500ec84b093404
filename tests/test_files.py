import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import region
from helixframe.plans.header import parse_header
from helixframe.plans.variants import parse_records
from helixframe.records import stream
from helixframe.sources import bgzf, datasource, read, tabix, write
from helixframe.streaming.lines import read_stream

HEAD = """##fileformat=VCFv4.3
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="d">
##contig=<ID=b,length=9>
##contig=<ID=a,length=9>
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	S
"""


def body(n=30_000, seed=1):
    rng = random.Random(seed)
    out = []
    for chrom in ("b", "a"):
        pos = 0
        for _ in range(n // 2):
            pos += rng.randint(1, 60)
            out.append(f"{chrom}\t{pos}\trs{rng.randint(1, 10**9)}\t{rng.choice(['A', 'ACGT', 'G'])}\tT\t{rng.random():.3f}\t.\tDP={rng.randint(0, 99)}\tGT\t0/1\n")
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("vcf")
    text = HEAD + "".join(body())
    (folder / "x.vcf").write_text(text)
    with gzip.open(folder / "plain.vcf.gz", "wt") as f:
        f.write(text)
    with bgzf.BgzfWriter(str(folder / "x.vcf.gz")) as f:
        f.write(text)
    tabix.write_index(str(folder / "x.vcf.gz"))
    return folder, text


@pytest.mark.parametrize("name", ["x.vcf", "plain.vcf.gz", "x.vcf.gz"])
def test_scan(spark, files, name):
    folder, text = files
    lines = read.read_lines(spark, str(folder / name)).orderBy("line_no").select("value").toPandas().value.tolist()
    assert lines == text.splitlines()
    assert read.read_header(spark, str(folder / name)).to_text() == HEAD


@pytest.mark.parametrize("size", [1 << 14, 70_000, 1 << 30])
def test_split_ranges(files, size):
    folder, text = files
    parts = datasource.split_ranges(str(folder / "x.vcf.gz"), size)
    assert [r[2] for p in parts for r in datasource.read_range(p)] == text.splitlines()


def test_line_starts_at_block_start(tmp_path):
    path = str(tmp_path / "y.gz")
    with open(path, "wb") as f:
        for i in range(20):
            f.write(bgzf.compress(f"line {i}\n".encode()))
        f.write(bgzf.EOF_BLOCK)
    for size in (30, 41, 60, 100):
        got = [r[2] for p in datasource.split_ranges(path, size) for r in datasource.read_range(p)]
        assert got == [f"line {i}" for i in range(20)], size


def expected(text, chrom, start, end):
    out = []
    for line in text.splitlines():
        if line[0] != "#":
            c, p, _, ref = line.split("\t")[:4]
            if c == chrom and (end is None or int(p) <= end) and (start is None or int(p) + len(ref) - 1 >= start):
                out.append(line)
    return out


@pytest.mark.parametrize("chrom, start, end", [("b", None, None), ("a", 1, 500), ("a", 100_000, 150_000), ("b", 300_000, None), ("b", 16_384, 16_385)])
def test_indexed_fetch(spark, files, chrom, start, end):
    folder, text = files
    path = str(folder / "x.vcf.gz")
    reader = read.Reader.from_path(spark, path, tabix_path=f"{path}.tbi")
    asked = chrom if start is None else f"{chrom}:{start:,}" + (f"-{end:,}" if end else "")
    assert sorted(reader.fetch(asked).toPandas().line.tolist()) == sorted(expected(text, chrom, start, end))


def test_index_prunes(files):
    folder, _ = files
    index = tabix.read_index(str(folder / "x.vcf.gz.tbi"))
    whole = tabix.plan_chunks(index, "a")
    part = tabix.plan_chunks(index, "a", 100_000, 110_000)
    assert part and sum(b - a for a, b in part) < sum(b - a for a, b in whole) / 4
    with pytest.raises(ValueError):
        tabix.plan_chunks(index, "z")
    with pytest.raises(ValueError):
        tabix.decode(b"nope")


def test_write_round_trip(spark, files, tmp_path):
    folder, text = files
    for source, target in (("x.vcf", "out.vcf"), ("x.vcf.gz", "out.vcf.gz")):
        v = read.read_vcf(spark, str(folder / source))
        path = str(tmp_path / target)
        write.write_vcf(v, read.read_header(spark, str(folder / source)), path)
        data = gzip.open(path, "rt").read() if path.endswith(".gz") else open(path).read()
        assert data == text
    with open(path, "rb") as f:
        assert f.read().endswith(bgzf.EOF_BLOCK)


def test_write_sorted(spark, tmp_path):
    h = parse_header(HEAD.splitlines())
    v = read.from_lines(spark, ["a\t5\t.\tA\tC\t.\t.\t.\tGT\t0", "b\t7\t.\tA\tC\t.\t.\t.\tGT\t0", "b\t2\t.\tA\tC\t.\t.\t.\tGT\t0"], h)
    write.write_vcf(v, h, str(tmp_path / "s.vcf"), order=write.contig_order(h))
    assert [x.split("\t")[:2] for x in open(tmp_path / "s.vcf") if x[0] != "#"] == [["b", "2"], ["b", "7"], ["a", "5"]]
    write.write_parts(v, h, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 3


@pytest.mark.parametrize("parts", [1, 5])
def test_index_written_with_the_file(spark, files, tmp_path, parts):
    """The sink's index, the one tasks build of a file, and the one built line by line are the same."""
    folder, _ = files
    h = read.read_header(spark, str(folder / "x.vcf"))
    v = read.read_vcf(spark, str(folder / "x.vcf"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        path = str(tmp_path / "i.vcf.gz")
        write.write_vcf(v, h, path, order=write.contig_order(h), index=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    slow = tabix.build_index(path)
    with_tasks = tabix.read_index(tabix.write_index(path, str(tmp_path / "tasks.tbi"), spark))
    # The last line may end before the end mark, after it, or at no named place.
    end = (os.path.getsize(path) - len(bgzf.EOF_BLOCK)) << 16
    places = lambda i: {c: ([(b, [(x, min(y, end)) for x, y in cs]) for b, cs in s.bins.items()], s.linear) for c, s in i.sequences.items()}
    assert places(tabix.read_index(f"{path}.tbi")) == places(with_tasks) == places(slow)
    assert not list(tmp_path.glob("*.parts-*"))
    with pytest.raises(ValueError):
        write.write_vcf(v, h, str(tmp_path / "i.vcf"), index=True)


def test_index_beside_the_file(spark, files):
    folder, text = files
    path = str(folder / "x.vcf.gz")
    reader = read.Reader.from_path(spark, path)
    assert reader.tabix_path.endswith("x.vcf.gz.tbi")
    got = reader.fetch("a:100,000")
    assert "vcf" in got._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(got.toPandas().line.tolist()) == sorted(expected(text, "a", 100_000, None))
    assert read.Reader.from_path(spark, str(folder / "plain.vcf.gz")).tabix_path is None
    with pytest.raises(ValueError, match="unknown sequence"):
        reader.fetch("zz")
    assert reader.fetch("a", 10**8, 10**8 + 5).count() == 0


def test_tabix_file(spark, files):
    folder, text = files
    with tabix.TabixFile(spark, str(folder / "x.vcf.gz")) as f:
        assert f.references == ["b", "a"]
        assert sorted(r.value for r in f.fetch("a", 1, 500).collect()) == sorted(expected(text, "a", 1, 500))
        assert sorted(r.value for r in f.fetch(region="b:400,000").collect()) == sorted(expected(text, "b", 400_000, None))
        assert f.fetch(reference="a").count() == len(expected(text, "a", None, None))
        for bad in ({"reference": "q"}, {"region": "a:1-2", "reference": "a"}, {"start": 1}):
            with pytest.raises(ValueError):
                f.fetch(**bad)
    assert f.closed
    with pytest.raises(ValueError):
        f.fetch("a")


def test_files_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(Exception, match="nothing.vcf.gz"):
        read.read_lines(spark, str(tmp_path / "nothing.vcf.gz"))
    with gzip.open(tmp_path / "plain.vcf.bgz", "wt") as f:
        f.write(HEAD)
    with pytest.raises(ValueError, match="blocks"):
        read.read_lines(spark, str(tmp_path / "plain.vcf.bgz"))


@pytest.mark.parametrize("name", ["l.vcf", "l.vcf.gz"])
def test_encoding(spark, tmp_path, name):
    text = HEAD.replace('Description="d"', 'Description="größe"') + "a\t1\té\tA\tC\t.\t.\tDP=1\tGT\t0\n"
    path = str(tmp_path / name)
    data = text.encode("latin-1")
    with open(path, "wb") as f:
        f.write(bgzf.compress_all(data) + bgzf.EOF_BLOCK if name.endswith("gz") else data)
    v = read.read_vcf(spark, path, encoding="latin-1")
    assert v.first().id == ["é"]
    assert read.read_header(spark, path, encoding="ISO-8859-1").get_info_field_info("DP").description == "größe"


def test_streams(spark, tmp_path):
    lines = [*HEAD.splitlines(), *(f"a\t{p}\t.\tA\tC\t.\t.\t.\tGT\t0" for p in (9, 3, 5))]
    text = "\n".join(lines) + "\n"
    reader = read.Reader.from_stream(spark, io.StringIO(text))
    assert [x.pos for x in reader] == [9, 3, 5]
    with pytest.raises(ValueError):
        read.Reader.from_stream(spark, io.StringIO(text), tabix_path="x.tbi")
    made = list(stream(reader.variants().orderBy("line_no"), reader.header))
    (tmp_path / "plain").mkdir()
    with open(tmp_path / "plain" / "t.vcf", "w") as raw, write.Writer.from_stream(raw, reader.header) as out:
        out.write(reader.variants())
        for r in made:
            out.write_record(r)
    assert (tmp_path / "plain" / "t.vcf").read_text() == text + "".join(x + "\n" for x in lines[-3:])
    for target in ("o.vcf", "o.vcf.gz"):
        with write.Writer.from_path(str(tmp_path / target), reader.header) as out:
            for r in made:
                out.write_record(r)
            with pytest.raises(ValueError):
                out.write(reader.variants())
        assert (gzip.open if target.endswith("gz") else open)(tmp_path / target, "rt").read() == text
    with open(tmp_path / "b.gz", "wb") as raw, write.Writer.from_stream(raw, reader.header, use_bgzf=True) as out:
        out.write_record(made[0])
    assert gzip.open(tmp_path / "b.gz", "rt").read() == "\n".join(lines[:-2]) + "\n"
    with write.Writer.from_path(str(tmp_path / "empty.vcf"), reader.header):
        pass
    assert (tmp_path / "empty.vcf").read_text() == HEAD
    with write.Writer.from_path(str(tmp_path / "frame.vcf"), reader.header) as out:
        out.write(reader.variants())
        with pytest.raises(ValueError):
            out.write_record(made[0])
    assert (tmp_path / "frame.vcf").read_text() == text
    with pytest.raises(ValueError):
        write.Writer(None, reader.header)


def test_blocks():
    data = bytes(random.Random(3).randbytes(200_000)) + b"x" * 200_000
    packed = bgzf.compress_all(data) + bgzf.EOF_BLOCK
    assert gzip.decompress(packed) == data
    packed_file = io.BytesIO(packed)
    assert bgzf.next_block(packed_file, 0) == 0 and bgzf.next_block(packed_file, 1) == bgzf.block_size(packed[:18])
    broken = bytearray(packed)
    broken[bgzf.block_size(packed[:18]) - 8] ^= 1
    with pytest.raises(ValueError):
        bgzf.read_block(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        bgzf.read_block(io.BytesIO(b"plain text, no block at all"))


def test_random_access(tmp_path):
    path = str(tmp_path / "r.gz")
    lines = [f"{i} {'y' * (i % 97)}\n" for i in range(20_000)]
    with bgzf.BgzfWriter(path) as f:
        f.writelines(lines)
    with pytest.raises(ValueError):
        bgzf.BgzfReader(path, max_cache=0)
    with bgzf.BgzfReader(path, max_cache=2) as f:
        places = []
        for want in lines:
            places.append(f.tell())
            assert f.readline() == want
        assert f.readline() == ""
        for i in random.Random(5).sample(range(len(lines)), 200):
            f.seek(places[i])
            assert f.readline() == lines[i]
        f.seek(0)
        assert f.read(10) == "".join(lines)[:10] and len(f.readlines(1000)) < 100
        with pytest.raises(NotImplementedError):
            f.read(-1)
        with pytest.raises(OSError):
            f.write("x")
    assert f.closed
    with bgzf.BgzfWriter(path) as f, pytest.raises(OSError):
        f.read()


def test_region_text():
    assert region.parse_region("a:1,000-2,000") == ("a", 1000, 2000)
    assert region.parse_region("a:5") == ("a", 5, None) and region.parse_region("a") == ("a", None, None)
    with pytest.raises(ValueError):
        region.resolve("a:1", chrom="a")
    with pytest.raises(ValueError):
        region.resolve(start=1)


def test_fetch_many(spark, files):
    folder, text = files
    v = read.read_vcf(spark, str(folder / "x.vcf"))
    asked = [("r1", "a", 100, 5000), ("r2", "b", 1, 1), ("r3", "a", 16_000, 17_000), ("r4", "z", 1, 9)]
    got = region.fetch_many(v, spark.createDataFrame(asked, "region_id string, chrom string, start long, end long")).select("region_id", "line").toPandas()
    for r, c, s, e in asked:
        assert sorted(got[got.region_id == r].line) == sorted(expected(text, c, s, e))
    # Open ends, whole sequences, wide regions, and columns named like the operator's own.
    asked = [("r1", "a", 100, None), ("r2", "b", None, None), ("r3", "a", None, 9000), ("r4", "b", 5, 1 << 28), ("r5", "a", 300, 400), ("r6", "b", 0, 0)]
    taken = v.withColumn("filed", F.lit("x")).withColumn("region_key", F.lit(7)).withColumn("_bin", F.lit(1))
    out = region.fetch_many(taken, spark.createDataFrame(asked, "region_id string, chrom string, start long, end long"))
    assert out.columns == ["region_id", *taken.columns]
    got = out.select("region_id", "line", "filed", "region_key").toPandas()
    assert set(got.filed) == {"x"} and set(got.region_key) == {7}
    for r, c, s, e in asked:
        assert sorted(got[got.region_id == r].line) == sorted(expected(text, c, s, e)), r
    assert region.fetch_many(v, spark.createDataFrame([], "region_id string, chrom string, start long, end long")).count() == 0
    with pytest.raises(ValueError):
        region.fetch(v, "z:1-2", contigs=["a", "b"])


def test_pushed_down(spark, files):
    """A region over stored records reaches the scan."""
    folder, _ = files
    v = read.read_vcf(spark, str(folder / "x.vcf"))
    path = str(folder / "stored")
    v.drop("info_t").write.mode("overwrite").parquet(path)
    plan = region.fetch(spark.read.parquet(path), "a:100-200").select("chrom", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(chrom)" in plan and "ReadSchema: struct<chrom:string,pos:bigint,ref:string>" in plan


def test_stream(spark, files, tmp_path):
    folder, text = files
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.vcf").write_text(text)
    (tmp_path / "in" / "2.vcf").write_text("b\t1\t.\tA\tC\t.\t.\tDP=5\tGT\t0\nbad line\n")
    arriving = read_stream(spark, str(tmp_path / "in"), parse_header(HEAD.splitlines()), files_per_trigger=1)
    q = arriving.select("chrom", "pos", "info_t.DP", F.col("error").isNotNull().alias("bad")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT count(*) AS n, sum(CAST(bad AS INT)) AS bad FROM arrived").first()
    assert (rows.n, rows.bad) == (30_002, 1)


def test_malformed_files(spark, tmp_path):
    (tmp_path / "no_header.vcf").write_text("1\t5\t.\tA\tC\t.\t.\t.\n")
    with pytest.raises(Exception, match="CHROM"):
        read.read_header(spark, str(tmp_path / "no_header.vcf"))


def test_iterates_in_order(spark):
    lines = [*HEAD.splitlines(), *(f"a\t{p}\t.\tA\tC\t.\t.\t.\tGT\t0" for p in (9, 3, 5))]
    with read.Reader.from_lines(spark, lines) as r:
        assert [x.pos for x in r] == [9, 3, 5]
        assert [x.pos for x in r.fetch("a", 4, 9).collect()] == [9, 5]
        with pytest.raises(ValueError):
            r.fetch("a", 4)


def test_empty(spark):
    h = parse_header(HEAD.splitlines())
    assert parse_records(spark.createDataFrame([], "value string"), h).count() == 0
