"""Python functions of one value, run over Arrow batches in short stretches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

STRETCH = 128


def per_value(result: T.DataType):
    """Column function of a Python function that takes one value; null stays null.

    Spark bounds the batches that reach a worker. Of these only ``STRETCH`` values and their results are Python objects at a
    time, and results leave the worker as they come, so its memory is about one batch whatever the function returns.
    """

    def wrap(fn: Callable):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = to_arrow_type(result)
            for batch in batches:
                for at in range(0, len(batch), STRETCH):
                    yield pa.array([None if v is None else fn(v) for v in batch.slice(at, STRETCH).to_pylist()], kind)

        return F.arrow_udf(run, result)

    return wrap
