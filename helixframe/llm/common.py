"""Shared plumbing: table access, durable intermediates and Arrow row mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows turned into Python objects at a time.
SLICE = 500
#: For ``slices``: batches as they come.
WHOLE = 1 << 30
_held: dict = {}
_asked = False


def held(key, make: Callable):
    """An object that a worker process keeps between tasks; one at a time, as workers serve many operators."""
    global _asked
    _asked = True
    if key not in _held:
        _held.clear()
        gc.collect()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Hand what this process has freed to the system; Arrow and the C library keep it for themselves otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def begin_task() -> None:
    """Start a task with what it needs alone: a held object that nobody asked for since the last start goes.

    Workers serve all operators of a session, and each would add what it left behind.
    """
    global _asked
    if not _asked:
        _held.clear()
    _asked = False
    give_back()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a task's batches in smaller ones."""
    begin_task()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (``spark.checkpoint.dir``).

    Only where the session leaves it unset (tests on one machine) a temporary
    folder of this machine stands in.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    jsc = sc._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get()
    base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    sc.setCheckpointDir(base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here.

    The files outlive any executor.  The read uses the written schema, so an
    empty result needs no inference.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    return out


def behind(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, a view of a ``stored`` table, so that discarding the view discards the table."""
    df._helix_path = table._helix_path
    return df


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a ``stored`` frame that nothing reads any more."""
    path = getattr(df, "_helix_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[..., list]],
    rows: int = SLICE,
) -> DataFrame:
    """Apply a batch function to ``columns`` of ``df`` in Arrow batches, ``rows`` at a time.

    ``make()`` runs once in each Python worker task and returns a function of
    one Python list per column that returns one list per output column.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.fieldNames()
    arrow = arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, rows):
            out = work(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, arrow.field(i).type) for i, c in enumerate(out)],
                names=names,
            )

    return df.select(*columns).mapInArrow(run, target)


def arrow_schema(schema) -> pa.Schema:
    """The Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
