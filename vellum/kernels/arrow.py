"""Per-document kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship_package, spread


def per_row(df: DataFrame, kernel: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Rows (dicts) that ``kernel`` yields for each row of ``df``, without a shuffle."""
    out: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for args in zip(*(c.to_pylist() for c in batch.columns)) for r in kernel(*args)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    ship_package(df.sparkSession)
    return spread(df).mapInArrow(run, out)
