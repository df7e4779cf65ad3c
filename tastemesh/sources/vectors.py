"""Saved item vectors, kept apart by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, params: Mapping[str, object]) -> str:
    """Hash of the rows of ``df`` (in any order) and of the parameters.

    One pass over the input; only one row reaches the driver. NULLs are marked by column, since the hash
    of a row passes over them.
    """
    values = [F.to_json(c) if "array" in t else F.col(c) for c, t in df.dtypes]
    row_hash = F.xxhash64(*(x for v in values for x in (v.isNull(), v)))
    n, total, mixed = df.select(row_hash.alias("h")).agg(
        F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")
    ).first()
    text = json.dumps([n, str(total), mixed, sorted((k, repr(v)) for k, v in params.items())])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def load_or_build(
    items: DataFrame, params: Mapping[str, object], root: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The vectors saved for this input and these parameters; built and saved on first use.

    Only a folder that its job has marked as finished counts as saved.
    """
    spark = items.sparkSession
    path = f"{root.rstrip('/')}/vectors-{fingerprint(items, params)}"
    if not _finished(spark, path):
        build(items).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
