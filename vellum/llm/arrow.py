"""Row kernels run over Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship_package, spread


@contextmanager
def no_cycles() -> Iterator[None]:
    """Pauses the search for cycles while a batch of rows is read by code that makes none."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


def values(column: pa.Array) -> list:
    """``to_pylist()``, at once where the rows are lists of numbers."""
    if not (pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type)):
        return column.to_pylist()
    flat = column.values
    if flat.null_count:
        numbers = flat.fill_null(0).to_numpy().astype(object)
        numbers[flat.is_null().to_numpy(zero_copy_only=False)] = None
    else:
        numbers = flat.to_numpy()
    numbers, ends = numbers.tolist(), column.offsets.to_pylist()
    rows = [numbers[a:b] for a, b in zip(ends, ends[1:])]
    return [r if v else None for r, v in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Apply a row kernel to every row of ``df`` without a shuffle.

    ``make()`` runs once a task and returns a function which takes the columns of one row and yields
    output tuples.  Rows move as Arrow batches in both directions.
    """
    out: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            rows = [r for args in zip(*(values(c) for c in batch.columns)) for r in kernel(*args)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target
                )

    ship_package(df.sparkSession)
    return spread(df).mapInArrow(run, out)
