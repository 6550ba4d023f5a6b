"""Arrow UDFs that are made when they are called, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of a batch that are Python objects at a time; one larger row is a slice of its own.
SLICE = 1 << 19
#: Rows that Spark sends to a Python worker at a time.
ROWS = 500


def row_bytes(c: pa.Array) -> np.ndarray:
    """About how many bytes each row holds."""
    if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
        return pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
        upto = np.concatenate([[0], np.cumsum(row_bytes(c.values))])
        return np.diff(upto[c.offsets.to_numpy()]) + 8
    if pa.types.is_struct(c.type):
        return sum((row_bytes(child) for child in c.flatten()), np.full(len(c), 8, np.int64))
    return np.full(len(c), 8, np.int64)


def slices(columns: tuple[pa.Array, ...], most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of about ``most`` bytes."""
    size, at = np.cumsum(sum(row_bytes(c) for c in columns)), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, stop - at
        at = stop


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, so that a worker holds few long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a pandas function as a column function that returns ``kind`` (DDL). It sees a batch in slices of bounded size."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def made():
            out = to_arrow_type(DataType.fromDDL(kind))
            small_batches(SparkSession.active())

            def arrow(result: pd.Series | pd.DataFrame) -> pa.Array:
                return pa.array(result.to_dict("records"), out) if isinstance(result, pd.DataFrame) else pa.array(result, out, from_pandas=True)

            def run(*columns: pa.Array) -> pa.Array:
                parts = [arrow(f(*[c.slice(at, n).to_pandas() for c in columns])) for at, n in slices(columns, SLICE)]
                return pa.concat_arrays(parts) if parts else pa.array([], out)

            # the annotations tell Spark the kind of function; they can't be strings
            run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
            run.__name__ = f.__name__
            return F.arrow_udf(run, kind)

        @functools.wraps(f)
        def call(*columns) -> Column:
            return made()(*columns)

        call.udf = made
        return call

    return wrap
