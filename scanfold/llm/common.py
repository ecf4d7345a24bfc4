"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and the five ASCII control characters that the operators take for white space.
SPACES = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def spare(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, so that working columns never clash."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_batches(frame: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Run a function over each Arrow batch of a frame; it returns the columns of the result by name.

    ``step`` is built anew in each task by calling it once with no batch when it is a factory
    (it has the attribute ``starts``), so that caches live as long as a task.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind if isinstance(kind, StructType) else StructType())

    def run(batches):
        own = step() if getattr(step, "starts", False) else step
        for batch in batches:
            columns = own(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
                 else columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, schema)


def factory(function: Callable[[], Callable]) -> Callable:
    """Mark a function that makes a task's batch function."""
    function.starts = True
    return function
