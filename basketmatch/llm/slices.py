"""Python work on small slices of Arrow batches, so that a task holds few texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a slice.
ROWS = 500


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one has taken is given back before the next, as workers live on."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``run`` over ``df`` in slices of ROWS rows. Whole numbers stay exact beside nulls."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield batch.slice(at, ROWS).to_pandas(integer_object_nulls=True)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(slices(released(batches))):
            yield pa.RecordBatch.from_pandas(out, schema=types, preserve_index=False)

    return df.mapInArrow(arrow, schema)


def filter_slices(df: DataFrame, column: str, keep: Callable[[list], list]) -> DataFrame:
    """Rows of ``df`` whose value in ``column`` ``keep`` marks true, ROWS at a time."""

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield rows.filter(pa.array(keep(rows.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(arrow, df.schema)


def map_rows(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``run`` over the rows of each partition as tuples, ROWS of them together at a time."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = run(rows(released(batches)))
        while held := list(islice(out, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types.types)], schema=types)

    return df.mapInArrow(arrow, schema)
