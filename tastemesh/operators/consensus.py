"""What two recommendation lists agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def above(recs: DataFrame, min_score: float) -> DataFrame:
    return recs.where(F.col("score") > min_score)


def consensus(pearson: DataFrame, cosine: DataFrame, min_score: float = 3.5) -> DataFrame:
    """Pearson recommendations above ``min_score`` that the cosine list has too, with both scores."""
    other = cosine.select("user_id", "tmdb_id", F.col("score").alias("cosine_score"))
    return (
        above(pearson, min_score).withColumnRenamed("score", "pearson_score")
        .join(other, ["user_id", "tmdb_id"])
        .select("user_id", "title", "tmdb_id", "pearson_score", "cosine_score")
    )


def consensus_ids(pearson: DataFrame, cosine: DataFrame, min_score: float = 3.5) -> DataFrame:
    """The distinct ids in both lists, per user."""
    keys = ["user_id", "tmdb_id"]
    return above(pearson, min_score).select(*keys).intersect(cosine.select(*keys))


def consensus_counts(pearson: DataFrame, cosine: DataFrame, min_score: float = 3.5) -> DataFrame:
    """Per user the distinct ids of each list and of both: ``user_id, pearson, cosine, common``."""
    keys = ["user_id", "tmdb_id"]

    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("side"))

    sides = marked(above(pearson, min_score), "pearson").unionByName(marked(cosine, "cosine"))
    per_id = sides.groupBy(*keys).agg(
        F.max(F.col("side") == "pearson").alias("p"), F.max(F.col("side") == "cosine").alias("c"))
    return per_id.groupBy("user_id").agg(
        F.count_if("p").alias("pearson"), F.count_if("c").alias("cosine"),
        F.count_if(F.col("p") & F.col("c")).alias("common"))
