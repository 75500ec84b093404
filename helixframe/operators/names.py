"""Names for columns that an operator adds and takes away again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, longer by underscores where a column of the frames has it already, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
