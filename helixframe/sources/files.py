"""One view of files for the driver and the tasks.

The driver resolves a path against Spark's default file system once
(``qualified``); whoever opens it after that, opens the same file: local paths
by the standard library, others through Arrow's file systems.  A store that
Arrow does not know is an error, never a guess.
"""

from __future__ import annotations

import codecs
import os
import shutil
from typing import BinaryIO

from pyspark.sql import SparkSession

#: Other names of stores that Arrow knows.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def charset(encoding: str) -> str:
    """The name by which the JVM knows one of Python's encodings."""
    name = codecs.lookup(encoding).name
    return {"iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(name, name.upper())


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark itself would read it."""
    fs, where = _hadoop(spark, str(path))
    return where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def local(path: str) -> str | None:
    """The local path behind a bare path or a ``file:`` one; None for other stores."""
    if path.startswith("file:"):
        rest = path.removeprefix("file:")
        return "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return None if "://" in path else path


def _store(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def open_input(path: str) -> BinaryIO:
    """A seekable stream of a file."""
    here = local(path)
    if here is not None:
        return open(here, "rb")
    store, where = _store(path)
    return store.open_input_file(where)


def open_output(path: str) -> BinaryIO:
    """A stream that makes a file anew, and its folder."""
    here = local(path)
    if here is not None:
        if os.path.dirname(here):
            os.makedirs(os.path.dirname(here), exist_ok=True)
        return open(here, "wb")
    store, where = _store(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    return store.open_output_stream(where)


def join(spark: SparkSession, path: str, parts: list[str]) -> None:
    """Put ``parts`` together as one file, in order; the parts are gone afterwards.

    HDFS does so without touching the bytes; elsewhere they are copied as a
    stream, already rendered and compressed by the tasks.
    """
    if path.startswith("hdfs://"):
        fs, where = _hadoop(spark, path)
        fs.delete(where, False)
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        fs.rename(jvm.org.apache.hadoop.fs.Path(parts[0]), where)
        if parts[1:]:
            rest = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
            for i, p in enumerate(parts[1:]):
                rest[i] = jvm.org.apache.hadoop.fs.Path(p)
            fs.concat(where, rest)
        return
    with open_output(path) as out:
        for p in parts:
            with open_input(p) as part:
                shutil.copyfileobj(part, out, 8 << 20)
            delete(spark, p)
