"""Structured Streaming over growing folders of record lines.

A header is state of a file, so a stream is given one; parsing a line needs no
state, so late or repeated files need no watermark until they are aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.header import Header
from ..plans.variants import parse_records


def read_stream(spark: SparkSession, path: str, header: Header, info: Sequence[str] | None = None, checks: Sequence[str] = (), mode: str = "permissive", files_per_trigger: int | None = None) -> DataFrame:
    """The ``variants`` frame of lines as they arrive."""
    source = spark.readStream
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    return parse_records(source.text(path), header, info, checks, mode)
