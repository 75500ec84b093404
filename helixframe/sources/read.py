"""Reading VCF: the header on the driver, the records as a frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import region as regions
from ..plans.header import Header, parse_header
from ..plans.variants import parse_records
from . import datasource, files, tabix
from .bgzf import block_size


def _stream(spark: SparkSession, path: str):
    fs, where = files._hadoop(spark, path)
    return fs.open(where)


def header_text(spark: SparkSession, path: str, encoding: str = "utf-8") -> Iterator[str]:
    """The first lines of a file through Spark's file systems; reading stops when the caller does."""
    jvm = spark.sparkContext._jvm
    stream = _stream(spark, path)
    if path.endswith((".gz", ".bgz")):
        stream = jvm.java.util.zip.GZIPInputStream(stream)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, files.charset(encoding)))
    try:
        while (line := reader.readLine()) is not None:
            yield line
    finally:
        reader.close()


def read_header(spark: SparkSession, path: str, parsed_samples: Sequence[str] | None = None, encoding: str = "utf-8") -> Header:
    return parse_header(header_text(spark, path, encoding), list(parsed_samples) if parsed_samples else None)


def is_block_gzip(spark: SparkSession, path: str) -> bool:
    """Whether a compressed file is made of blocks, by its first bytes; a file that cannot be read is an error."""
    stream = _stream(spark, path)
    try:
        head = bytes(stream.readNBytes(64))
    finally:
        stream.close()
    return block_size(head) is not None


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``path, line_no, value``: ``line_no`` orders lines as in the file.

    Block-gzip files are split by block; plain files by Spark; other gzip files
    are one task.
    """
    path = files.qualified(spark, path)
    if path.endswith((".gz", ".bgz")) and is_block_gzip(spark, path):
        datasource.register(spark)
        lines = spark.read.format("vcf").option("encoding", encoding).load(path)
        return lines.select("path", F.col("offset").alias("line_no"), "value")
    if path.endswith(".bgz"):
        raise ValueError(f"{path} is not made of blocks")
    value = F.col("value")
    if files.charset(encoding) != "UTF-8":
        value = F.decode(value.cast("binary"), files.charset(encoding))
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), value.alias("value"))


def read_vcf(
    spark: SparkSession, path: str, parsed_samples: Sequence[str] | None = None, info: Sequence[str] | None = None, checks: Sequence[str] = (), mode: str = "failfast", encoding: str = "utf-8"
) -> DataFrame:
    """The ``variants`` frame of a file."""
    return parse_records(read_lines(spark, path, encoding), read_header(spark, path, parsed_samples, encoding), info, checks, mode)


def from_lines(spark: SparkSession, lines: Iterable[str], header: Header | None = None, **options) -> DataFrame:
    """The ``variants`` frame of lines in memory."""
    lines = [x.rstrip("\n") for x in lines]
    header = header or parse_header(lines)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, value string")
    return parse_records(frame, header, **options)


class Reader:
    """A file's header and records; records are a frame, iteration streams its rows.

    An index is used where ``tabix_path`` names it or ``path`` with ``.tbi`` exists.
    """

    def __init__(self, spark: SparkSession, path: str, header: Header, tabix_path: str | None = None, record_checks: Sequence[str] = (), encoding: str = "utf-8"):
        self.spark, self.path, self.header = spark, path, header
        self.tabix_path, self.record_checks, self.encoding = tabix_path, tuple(record_checks), encoding
        self._lines: DataFrame | None = None

    @classmethod
    def from_path(
        cls, spark: SparkSession, path: str, tabix_path: str | None = None, record_checks: Sequence[str] = (), parsed_samples: Sequence[str] | None = None, encoding: str = "utf-8"
    ) -> Reader:
        path = files.qualified(spark, path)
        if tabix_path is not None:
            tabix_path = files.qualified(spark, tabix_path)
        elif path.endswith((".gz", ".bgz")) and files.exists(spark, f"{path}.tbi"):
            tabix_path = f"{path}.tbi"
        return cls(spark, path, read_header(spark, path, parsed_samples, encoding), tabix_path, record_checks, encoding)

    @classmethod
    def from_lines(cls, spark: SparkSession, lines: Iterable[str], record_checks: Sequence[str] = (), parsed_samples: Sequence[str] | None = None) -> Reader:
        lines = [x.rstrip("\r\n") for x in lines]
        out = cls(spark, "", parse_header(lines, list(parsed_samples) if parsed_samples else None), None, record_checks)
        out._lines = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, value string")
        return out

    @classmethod
    def from_stream(
        cls, spark: SparkSession, stream: TextIO, path: str | None = None, tabix_path: str | None = None, record_checks: Sequence[str] = (), parsed_samples: Sequence[str] | None = None
    ) -> Reader:
        """From an open text file on the driver.  With a ``path``, regions are read from the file there."""
        if tabix_path is not None and path is None:
            raise ValueError("an index needs the path of its file")
        out = cls.from_lines(spark, stream, record_checks, parsed_samples)
        out.path = "" if path is None else files.qualified(spark, path)
        out.tabix_path = None if tabix_path is None else files.qualified(spark, tabix_path)
        return out

    def variants(self, **options) -> DataFrame:
        lines = self._lines if self._lines is not None else read_lines(self.spark, self.path, self.encoding)
        return parse_records(lines, self.header, checks=self.record_checks, **options)

    def fetch(self, chrom_or_region: str, begin: int | None = None, end: int | None = None) -> DataFrame:
        """Records that overlap a region, 1-based and with both ends; an index limits what is read."""
        if (begin is None) != (end is None):
            raise ValueError("begin and end go together")
        c, s, e = regions.parse_region(chrom_or_region) if begin is None else (chrom_or_region, begin, end)
        if self.tabix_path is None:
            return self.variants().where(regions.overlaps(c, s, e))
        lines = tabix.TabixFile(self.spark, self.path, self.tabix_path, self.encoding).lines(c, s, e)
        return parse_records(lines, self.header, checks=self.record_checks).where(regions.overlaps(c, s, e))

    def __iter__(self):
        frame = self.variants()
        return (frame.orderBy("line_no") if "line_no" in frame.columns else frame).toLocalIterator()

    def close(self) -> None:
        """Nothing stays open between queries."""

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()
