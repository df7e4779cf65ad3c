"""Dense vectors in arrays: mean per key, cosine with the mean of the key."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.functions.dense import cosine


def vector_mean(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key: ``key, mean`` with ``mean`` an array as long as the vectors; NULL vectors do not count.

    Whole vectors are added up with map-side combining, so a key with very many vectors is no hot spot.
    """
    dense = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return dense.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))


def cosine_with_mean(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The vectors with their cosine to the mean of their key, as ``cosine``."""
    means = vector_mean(vectors, key, vector)
    return vectors.join(means, key).withColumn("cosine", cosine(F.col(vector), F.col("mean"))).drop("mean")
