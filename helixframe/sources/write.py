"""Writing VCF: rendering, sorting, compression and indexing are distributed, one ordered file comes out."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Sequence
from typing import BinaryIO, TextIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import make_virtual_offset
from ..operators.render import render_lines
from ..plans.header import Header
from ..records import Record
from . import bgzf, files, tabix


def _ordering(lines: DataFrame, order: Sequence[str | Column] | None) -> list | None:
    return list(order) if order else [F.col("line_no")] if "line_no" in lines.columns else None


def contig_order(header: Header) -> list[Column]:
    """Order by the header's contigs, then place."""
    known = F.array(*map(F.lit, header.contigs())) if header.contigs() else F.array().cast("array<string>")
    at = F.array_position(known, F.col("chrom"))
    return [F.when(at > 0, at).otherwise(F.lit(1 << 30)), F.col("chrom"), F.col("pos")]


class _Part:
    """One task's share of a file: its bytes go to a file of their own as they come, its index beside them."""

    def __init__(self, path: str, blocks: bool, indexed: bool, encoding: str):
        self.out = files.open_output(path)
        self.blocks, self.encoding = blocks, encoding
        self.index = tabix.IndexPart() if indexed else None
        self.held = bytearray()
        self.text, self.size = 0, 0  # bytes before and after compression
        self.starts = [0]  # where blocks start in the part

    def add(self, line: str) -> None:
        data = line.encode(self.encoding) + b"\n"
        if self.index:
            self.index.add(line, self.text, self.text + len(data))
        self.text += len(data)
        self.held += data
        if len(self.held) >= bgzf.PAYLOAD * 16:
            self._flush(len(self.held) // bgzf.PAYLOAD * bgzf.PAYLOAD)

    def _flush(self, n: int) -> None:
        for i in range(0, n, bgzf.PAYLOAD):
            data = bytes(self.held[i : min(n, i + bgzf.PAYLOAD)])
            data = bgzf.compress(data) if self.blocks else data
            self.out.write(data)
            self.size += len(data)
            self.starts.append(self.size)
        del self.held[:n]

    def close(self) -> tuple[int, int, bytes]:
        """Bytes of the part and of its text, and its index with the starts of its blocks."""
        self._flush(len(self.held))
        self.out.close()
        return self.size, self.text, json.dumps([self.starts, self.index.dump().decode()]).encode() if self.index else b""


def _places(starts: list[int], text: int, before: int):
    """From a place in a part's text to its virtual offset in a file with ``before`` bytes before the part."""

    def offset(u: int) -> int:
        block, within = divmod(u, bgzf.PAYLOAD)
        return make_virtual_offset(before + (starts[-1] if u == text else starts[block]), 0 if u == text else within)

    return offset


def write_vcf(
    variants: DataFrame, header: Header, path: str, compression: str | None = None, order: Sequence[str | Column] | None = None, index: bool = False, encoding: str = "utf-8"
) -> None:
    """One file: header, records in order (``order``, or as they were read), end mark if compressed.

    ``compression``: ``bgzf``, ``none``, or by the path's ``.gz``/``.bgz``.  ``index``:
    also ``path`` with ``.tbi``; records must then be sorted by place.

    Records are rendered once, into a table beside the target; that table is
    sorted, so neither the sampling nor the sort works them out again.  Each
    task then compresses its range into a file of its own, named after its
    attempt, so that a task that is run again does no harm.  The driver joins
    these files and the index tables of the tasks, both small beside the records.
    """
    compression = compression or ("bgzf" if path.endswith((".gz", ".bgz")) else "none")
    blocks = compression == "bgzf"
    if index and not blocks:
        raise ValueError("only files of blocks have an index")
    spark = variants.sparkSession
    path = files.qualified(spark, path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    lines = render_lines(variants, header)
    keys = _ordering(lines, order)
    try:
        if keys:
            lines.write.parquet(f"{folder}/rendered")
            lines = spark.read.schema(lines.schema).parquet(f"{folder}/rendered").orderBy(*keys)

        def run(batches):
            part = None
            context = TaskContext.get()
            name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    part = part or _Part(name, blocks, index, encoding)
                    part.add(line)
            if part:
                size, text, table = part.close()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (context.partitionId(), name, size, text, table)], names=["number", "name", "size", "text", "part"])

        # One row for each task.
        parts = sorted(tuple(r) for r in lines.select("value").mapInArrow(run, "number long, name string, size long, text long, part binary").collect())
        head = header.to_text().encode(encoding)
        names = [f"{folder}/head", *(name for _, name, *_ in parts), f"{folder}/end"]
        first = bgzf.compress_all(head) if blocks else head
        for name, data in ((names[0], first), (names[-1], bgzf.EOF_BLOCK)):
            with files.open_output(name) as out:
                out.write(data)
        files.join(spark, path, names if blocks else names[:-1])
        if index:
            before = np.cumsum([len(first), *(size for _, _, size, *_ in parts)]).tolist()
            tables = ((json.loads(bytes(table)), text, at) for (_, _, _, text, table), at in zip(parts, before, strict=False))
            tabix.save_index(tabix.merge_parts((dump.encode(), _places(starts, text, at)) for (starts, dump), text, at in tables), f"{path}.tbi")
    finally:
        files.delete(spark, folder)


def write_parts(variants: DataFrame, header: Header, path: str, order: Sequence[str | Column] | None = None) -> None:
    """A folder of text parts without header, and the header beside it: nothing passes through the driver."""
    lines = render_lines(variants, header)
    keys = _ordering(lines, order)
    (lines.orderBy(*keys) if keys else lines).select("value").write.text(path)
    spark = variants.sparkSession
    spark.createDataFrame([(header.to_text().rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}.header")


def snv_table(variants: DataFrame, header: Header) -> DataFrame:
    """Genotypes of single-base changes, one column for each sample."""
    from ..functions.alleles import is_snv

    gts = variants.where(is_snv(F.col("ref"), F.col("alt"))).select(
        "chrom", "pos", "ref", F.array_join(F.transform("alt", lambda a: a["value"]), ",").alias("alt"), F.transform("calls", lambda c: F.coalesce(c["gt"], F.lit("./."))).alias("gts")
    )
    return gts.select("chrom", "pos", "ref", "alt", *[F.get("gts", F.lit(i)).alias(n) for i, n in enumerate(header.samples.names)])


class Writer:
    """Writes under one header, to a path or to an open binary or text stream on the driver.

    ``write`` takes a frame of records and ``write_record`` one object; a path
    takes one frame or any number of objects, a stream both in turn.
    """

    def __init__(self, path: str | None, header: Header, use_bgzf: bool | None = None, stream: BinaryIO | TextIO | None = None, encoding: str = "utf-8"):
        if (path is None) == (stream is None):
            raise ValueError("a writer has a path or a stream")
        self.path, self.header, self.encoding = path, header.copy(), encoding
        self.header.samples = header.samples
        blocks = path is not None and path.endswith((".gz", ".bgz")) if use_bgzf is None else use_bgzf
        self.compression = "bgzf" if blocks else "none"
        self._target = stream
        self._sink: bgzf.BgzfWriter | _Plain | None = None
        self._written = False

    @classmethod
    def from_path(cls, path: str, header: Header) -> Writer:
        return cls(str(path), header)

    @classmethod
    def from_stream(cls, stream: BinaryIO | TextIO, header: Header, use_bgzf: bool = False) -> Writer:
        """To a stream; blocks need a binary one."""
        return cls(None, header, use_bgzf, stream)

    def _open(self):
        if self._sink is None:
            if self._written:
                raise ValueError(f"{self.path} holds a frame already")
            stream = self._target if self._target is not None else files.open_output(self.path)
            self._sink = bgzf.BgzfWriter(fileobj=stream, encoding=self.encoding) if self.compression == "bgzf" else _Plain(stream, self.encoding)
            self._sink.write(self.header.to_text())
        return self._sink

    def write(self, variants: DataFrame, order: Sequence[str | Column] | None = None, index: bool = False) -> None:
        if self._target is None:
            if self._sink is not None:
                raise ValueError(f"{self.path} holds single records already")
            write_vcf(variants, self.header, self.path, self.compression, order, index, self.encoding)
            self._written = True
            return
        lines = render_lines(variants, self.header)
        keys = _ordering(lines, order)
        sink = self._open()
        for row in (lines.orderBy(*keys) if keys else lines).select("value").toLocalIterator():
            sink.write(row.value + "\n")

    def write_record(self, record: Record) -> None:
        self._open().write(record.to_line(self.header) + "\n")

    def close(self) -> None:
        """Ends the file; one that was given nothing holds the header alone."""
        if not self._written or self._sink is not None:
            self._open().close()
            self._written = True

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _Plain:
    """Text to a text or binary stream."""

    def __init__(self, stream, encoding: str):
        self._stream, self._encoding = stream, encoding
        self._binary = not isinstance(stream, io.TextIOBase)

    def write(self, text: str) -> None:
        self._stream.write(text.encode(self._encoding) if self._binary else text)

    def close(self) -> None:
        self._stream.close()

