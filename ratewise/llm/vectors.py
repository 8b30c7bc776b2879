"""Vector columns as numpy blocks, and sums of small arrays over all tasks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite values."""
    wrong = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~wrong


def block(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; every list has ``width`` values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def blobs(values: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    values = np.ascontiguousarray(values, np.uint8)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unblob(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as a byte matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, width)


def summed(partial: DataFrame, keys: list[str], values: str) -> list:
    """Sums over tasks of an array column, place by place: rows of (*keys, pos, total).

    The sums are made by a shuffle; what reaches the driver has one row per key and place, which does
    not grow with the input.
    """
    places = partial.select(*keys, F.posexplode(values).alias("pos", "v"))
    return places.groupBy(*keys, "pos").agg(F.sum("v").alias("total")).collect()


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later job reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
