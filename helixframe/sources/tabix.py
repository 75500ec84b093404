"""Tabix indexes: decoding, building, and which parts of a file a region needs."""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins
from ..operators import region as regions
from . import files
from .bgzf import EOF_BLOCK, BgzfReader, compress_all

#: Fixed value: the bin number under which an index keeps counts, not places.
META_BIN = 37450


@dataclass
class SequenceIndex:
    """Chunks (virtual offsets) by bin, and the least offset of each 16 kb window."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)


@dataclass
class TabixIndex:
    format: int = 2
    columns: tuple[int, int, int] = (1, 2, 0)
    meta_char: str = "#"
    skip: int = 0
    sequences: dict[str, SequenceIndex] = field(default_factory=dict)
    unplaced: int | None = None


def decode(data: bytes) -> TabixIndex:
    """An index from its decompressed bytes."""
    if data[:4] != b"TBI\x01":
        raise ValueError("not a tabix index")
    at = 4

    def take(form: str):
        nonlocal at
        out = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return out if len(out) > 1 else out[0]

    _, kind, seq, beg, end, meta, skip, names = take("8i")
    labels = data[at : at + names].decode().split("\0")[:-1]
    at += names
    index = TabixIndex(kind & 0xFFFF, (seq, beg, end), chr(meta), skip)
    for label in labels:
        s = SequenceIndex()
        for _ in range(take("i")):
            number, n = take("Ii")
            s.bins[number] = [take("QQ") for _ in range(n)]
        n = take("i")
        s.linear = list(struct.unpack_from(f"<{n}Q", data, at))
        at += 8 * n
        index.sequences[label] = s
    if len(data) - at >= 8:
        index.unplaced = take("Q")
    return index


def read_index(path: str) -> TabixIndex:
    with files.open_input(path) as raw, gzip.GzipFile(fileobj=io.BytesIO(raw.read())) as f:
        return decode(f.read())


def encode(index: TabixIndex) -> bytes:
    names = b"".join(n.encode() + b"\0" for n in index.sequences)
    out = [b"TBI\x01", struct.pack("<8i", len(index.sequences), index.format, *index.columns, ord(index.meta_char), index.skip, len(names)), names]
    for s in index.sequences.values():
        out.append(struct.pack("<i", len(s.bins)))
        for number, chunks in s.bins.items():
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        out.append(struct.pack(f"<i{len(s.linear)}Q", len(s.linear), *s.linear))
    return b"".join(out)


def _window_span(line: str) -> tuple[str, int, int] | None:
    """Sequence and half-open interval of a record line; None for other lines."""
    if not line or line.startswith("#"):
        return None
    chrom, pos, _, ref = line.split("\t", 4)[:4]
    first = int(pos) - 1
    return chrom, first, first + max(1, len(ref))


class IndexPart:
    """What consecutive lines of a file add to its index; places are of any kind that can be ordered."""

    def __init__(self):
        self.sequences: dict[str, tuple[dict[int, list], dict[int, int]]] = {}

    def add(self, line: str, begin, end) -> None:
        found = _window_span(line)
        if found is None:
            return
        chrom, first, last = found
        chunks_of, linear = self.sequences.setdefault(chrom, ({}, {}))
        number = next(base + (first >> shift) for base, shift in reversed(bins.LEVELS) if first >> shift == last - 1 >> shift)
        chunks = chunks_of.setdefault(number, [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for w in range(first >> bins.WINDOW_SHIFT, (last - 1 >> bins.WINDOW_SHIFT) + 1):
            linear.setdefault(w, begin)

    def dump(self) -> bytes:
        return json.dumps([[c, sorted(x.items()), sorted(w.items())] for c, (x, w) in self.sequences.items()]).encode()


def merge_parts(parts: Iterable[tuple[bytes, object]]) -> TabixIndex:
    """One index from the dumps of a file's parts in order, each with the function that makes its places virtual offsets."""
    index = TabixIndex()
    for data, offset in parts:
        for chrom, chunks_of, linear in json.loads(data):
            s = index.sequences.setdefault(chrom, SequenceIndex())
            for number, chunks in chunks_of:
                kept = s.bins.setdefault(number, [])
                for begin, end in ((offset(a), offset(b)) for a, b in chunks):
                    if kept and kept[-1][1] == begin:
                        kept[-1] = (kept[-1][0], end)
                    else:
                        kept.append((begin, end))
            for w, begin in linear:
                s.linear += [0] * (w + 1 - len(s.linear))
                s.linear[w] = min(s.linear[w] or offset(begin), offset(begin))
    for s in index.sequences.values():
        s.bins = dict(sorted(s.bins.items()))
    return index


def build_index(path: str) -> TabixIndex:
    """The index of a sorted block-gzip VCF file, read line by line on the driver."""
    part = IndexPart()
    with files.open_input(path) as raw, BgzfReader(fileobj=raw) as f:
        while True:
            begin = f.tell()
            line = f.readline()
            if not line:
                return merge_parts([(part.dump(), int)])
            part.add(line, begin, f.tell())


def index_lines(lines: DataFrame) -> TabixIndex:
    """The same from the rows ``line_no, value`` of ``read_lines``: tasks index their lines, the driver joins their tables.

    Within a task a line ends where the next begins; a task's last line ends
    where the next task's first begins.
    """

    def run(batches):
        part, held, first = IndexPart(), None, None
        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None:
                    first = at
                else:
                    part.add(held[1], held[0], at)
                held = (at, line)
        if held is not None:
            part.add(held[1], held[0], -1)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([part.dump()], pa.binary())], names=["first", "part"])

    rows = sorted(tuple(r) for r in lines.select("line_no", "value").mapInArrow(run, "first long, part binary").collect())
    ends = [first for first, _ in rows[1:]] + [(1 << 63) - 1]
    return merge_parts((bytes(data), lambda x, end=end: end if x == -1 else x) for (_, data), end in zip(rows, ends, strict=True))


def save_index(index: TabixIndex, path: str) -> str:
    with files.open_output(path) as f:
        f.write(compress_all(encode(index)) + EOF_BLOCK)
    return path


def write_index(path: str, index_path: str | None = None, spark: SparkSession | None = None) -> str:
    """Write the index of a sorted block-gzip file beside it; with a session, the file is read by tasks."""
    if spark is None:
        return save_index(build_index(path), index_path or f"{path}.tbi")
    from .read import read_lines

    path = files.qualified(spark, path)
    return save_index(index_lines(read_lines(spark, path)), files.qualified(spark, index_path or f"{path}.tbi"))


class TabixFile:
    """A block-gzip file and its index; what is fetched is a frame of lines.  Nothing stays open but the plan."""

    def __init__(self, spark: SparkSession, filename: str, index: str | None = None, encoding: str = "utf-8"):
        self.spark, self.filename, self.encoding = spark, files.qualified(spark, filename), encoding
        self.index_filename = files.qualified(spark, index) if index is not None else f"{self.filename}.tbi"
        self.index = read_index(self.index_filename)
        self.closed = False

    @property
    def references(self) -> list[str]:
        return list(self.index.sequences)

    def lines(self, reference: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """``path, line_no, value`` of the chunks that hold a region: all its lines, and others near them."""
        from . import datasource

        if self.closed:
            raise ValueError("the file is closed")
        if reference not in self.index.sequences:
            raise ValueError(f"unknown sequence {reference}")
        datasource.register(self.spark)
        text = reference if start is None and end is None else f"{reference}:{start or 1}" if end is None else f"{reference}:{start or 1}-{end}"
        rows = self.spark.read.format("vcf").option("region", text).option("index", self.index_filename).option("encoding", self.encoding).load(self.filename)
        return rows.select("path", F.col("offset").alias("line_no"), "value")

    def fetch(self, reference: str | None = None, start: int | None = None, end: int | None = None, region: str | None = None) -> DataFrame:
        """Lines that overlap a region, 1-based and with both ends."""
        c, s, e = regions.resolve(region, reference, start, end)
        fields = F.split("value", "\t", 5)
        rows = self.lines(c, s, e).where(~F.startswith("value", F.lit("#")))
        placed = rows.withColumns({"chrom": fields[0], "pos": fields[1].cast("long"), "ref": fields[3]})
        return placed.where(regions.overlaps(c, s, e)).select("path", "line_no", "value")

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> TabixFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def plan_chunks(index: TabixIndex, chrom: str, start: int | None = None, end: int | None = None) -> list[tuple[int, int]]:
    """Ranges of virtual offsets that hold a region's records: sorted, apart from each other.

    1-based, both ends included.  The linear index drops chunks that end before
    the region can begin.
    """
    if chrom not in index.sequences:
        raise ValueError(f"unknown sequence {chrom}")
    s = index.sequences[chrom]
    if start is None and end is None:
        chunks = [c for number, cs in s.bins.items() if number != META_BIN for c in cs]
    else:
        begin = max(0, (start or 1) - 1)
        stop = end if end is not None else 1 << 29
        chunks = [c for b in bins.region_bins(begin, stop) for c in s.bins.get(b, ())]
        window = begin >> bins.WINDOW_SHIFT
        least = s.linear[window] if window < len(s.linear) else 0
        chunks = [c for c in chunks if c[1] > least]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(c for c in chunks if c[1]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
