"""Top-k per key, and ranks of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemesh.sources.staging import stage


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each key in the given order, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; all rows when ``k`` is None.

    Spark turns ``row_number <= k`` into a group limit that runs before the shuffle too, so at most
    ``k`` rows per key and map task travel however large one key is.
    """
    numbered = ranked(df, by, order, name)
    return numbered if k is None else numbered.where(F.col(name) <= k)


def whole_ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows of each key from 1, as ``ranked`` does, without a task that holds a whole key.

    Rows are dealt out by ranges of key and order, so a large key lies in several ranges. A row's number is its place
    in its range and the key's rows in earlier ranges. Those counts are needed only for keys that go on from one
    range to the next: at most one a range, which is why they can be broadcast. ``order`` must tell rows of a key apart
    for the numbers to be the same in every run; without ``by`` the whole table is one key.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = list(by)
    placed = stage(df.repartitionByRange(ranges, *by, *order).withColumn("rank_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*by).orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "rank_range").agg(F.count("*").alias("rank_rows"))
    continued = counts.select(*by, "rank_range", F.sum("rank_rows").over(earlier).alias("rank_before")).where("rank_before > 0")
    numbered = placed.withColumn(name, F.row_number().over(Window.partitionBy(*by, "rank_range").orderBy(*order)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "rank_range")]
    joined = numbered.alias("r").join(F.broadcast(continued.alias("c")), same, "left")
    number = F.col(f"r.{name}") + F.coalesce(F.col("c.rank_before"), F.lit(0))
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), number.cast("int" if by else "long").alias(name))
