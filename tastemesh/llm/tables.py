"""Input tables and small Arrow helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def signed(hashes: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's longs."""
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))


def lists(values: pa.Array, sizes) -> pa.Array:
    """Arrow lists of the given sizes over consecutive values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(name).cast(pa.int64())


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without null elements; null lists are empty."""
    offsets = np.zeros(len(column) + 1, np.int64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if len(column) else []
    np.cumsum(sizes, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets


Batches = Iterator[pa.RecordBatch]
