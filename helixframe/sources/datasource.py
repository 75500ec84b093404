"""``spark.read.format("vcf")``: the lines of a block-gzip file, split by block.

Options: ``path``; ``partition_bytes`` (compressed bytes of a task, 32 MiB by
default); ``region`` with ``index`` to read only the chunks an index names;
``encoding`` (UTF-8 by default).
Rows: ``path, offset, value``; ``offset``, the line's virtual offset, orders
them as in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bins import make_virtual_offset
from . import tabix
from .bgzf import BgzfReader, next_block
from .files import open_input

SCHEMA = "path string, offset bigint, value string"


class Range(InputPartition):
    """Lines that begin at a virtual offset of at least ``begin`` and less than ``end``."""

    def __init__(self, path: str, begin: int, end: int, whole_lines: bool):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end, self.whole_lines = path, begin, end, whole_lines


def split_ranges(path: str, size: int) -> list[Range]:
    """Even ranges of compressed bytes; their ends are moved to block starts by the tasks."""
    with open_input(path) as f:
        f.seek(0, 2)
        total = f.tell()
    return [Range(path, at, min(at + size, total), False) for at in range(0, total, size)]


def read_range(part: Range, encoding: str = "utf-8") -> Iterator[tuple[str, int, str]]:
    with open_input(part.path) as stream:
        begin, end = part.begin, part.end
        if not part.whole_lines:
            first = 0 if begin == 0 else next_block(stream, begin)
            if first is None or first >= end and begin:
                return
            begin, end = make_virtual_offset(first, 0), None
        reader = BgzfReader(fileobj=stream)
        reader.seek(begin)
        if not part.whole_lines and part.begin:
            # The line that runs into this range belongs to the one before; so does a line that begins right here.
            reader.readline_bytes()
        while True:
            at = reader.tell()
            # A range takes lines up to and with the one that begins at its end.
            if at >= end if part.whole_lines else at > make_virtual_offset(part.end, 0) and at > make_virtual_offset(next_start(stream, part), 0):
                return
            line = reader.readline_bytes()
            if not line:
                return
            yield part.path, at, line.decode(encoding).rstrip("\r\n")


def next_start(stream, part: Range) -> int:
    """The first block at or after a range's end: where the next range begins."""
    if not hasattr(part, "_next"):
        place = stream.tell()
        found = next_block(stream, part.end)
        stream.seek(place)
        part._next = part.end if found is None else found
    return part._next


class VcfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.size = int(options.get("partition_bytes", 32 << 20))
        self.region, self.index = options.get("region"), options.get("index")
        self.encoding = options.get("encoding", "utf-8")
        if not self.path:
            raise ValueError("option path is missing")

    def partitions(self) -> list[Range]:
        if not self.region:
            return split_ranges(self.path, self.size)
        from ..operators.region import parse_region

        index = tabix.read_index(self.index or f"{self.path}.tbi")
        return [Range(self.path, a, b, True) for a, b in tabix.plan_chunks(index, *parse_region(self.region))]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no chunk to read: the one task that is run gets no range
            return
        rows: list[tuple[str, int, str]] = []
        names = ["path", "offset", "value"]
        for row in read_range(part, self.encoding):
            rows.append(row)
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


class VcfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VcfReader:
        return VcfReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VcfDataSource)
