"""Helpers the operators share: work tables in the shared folder, document keys, column names."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, work_path

__all__ = ["cut_lineage", "stored", "map_batches", "map_groups", "text_of", "document", "free_name", "read", "settle"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of the shared folder and read again: computed once, safe when executors are lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when their handles are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` alone, so other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; it yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in fn(batch):
                yield to_batch(cols, target)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` on every group of rows with equal keys (columns as lists), for groups of bounded size.

    Groups of a partition follow each other in its sorted rows, so one group is held at a time, and small groups cost little.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        out: dict[str, list] = {f.name: [] for f in target}

        def close() -> None:
            for name, values in fn(held).items():
                out[name].extend(values)

        for batch in batches:
            cols = batch.to_pydict()
            at = list(zip(*(cols[k] for k in keys), strict=True))
            lo = 0
            for i in range(1, len(at) + 1):
                if i < len(at) and at[i] == at[lo]:
                    continue
                part = {k: v[lo:i] for k, v in cols.items()}
                if held is not None and at[lo] == now:
                    for k, v in part.items():
                        held[k].extend(v)
                else:
                    if held is not None:
                        close()
                    now, held = at[lo], part
                lo = i
            if out and len(next(iter(out.values()))) > 10_000:
                yield to_batch(out, target)
                out = {f.name: [] for f in target}
        if held is not None:
            close()
            yield to_batch(out, target)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def to_batch(cols: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) and c.type == f.type else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for f in target], schema=target)
