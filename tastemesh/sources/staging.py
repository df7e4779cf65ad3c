"""Tables written once in the cluster's shared folder and read by several branches of a job."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str | None:
    """The shared folder that ``spark.checkpoint.dir`` names, if any."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else None


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors without recomputation, and gives the readers column
    pruning and true sizes. Used where a table feeds several branches of one job. The folders, one per
    application, may be cleared once the application has ended. Without a shared folder the rows are kept on
    the executors' disks instead and computed again where one is lost.
    """
    spark = df.sparkSession
    shared = shared_dir(spark)
    if shared is None:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{shared}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
