"""The test tables seen as a catalog, ratings, links and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemesh.operators.history import export_history


class Views:
    """Lazy views over one scale factor's folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sales(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def ratings(self) -> DataFrame:
        """Whole ratings from 1 to 5."""
        return self._sales().select(
            F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("movieId"),
            F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        )

    def raw_ratings(self) -> DataFrame:
        """Ratings in steps of 0.2, partly outside [0, 5]: clipped, they hold zeros and fractions."""
        return self._sales().select(
            F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("movieId"),
            (F.col("l_quantity") / 5.0 - 1.0).alias("rating"),
        )

    def links(self) -> DataFrame:
        """External ids of every part; some missing, empty or 'nan', the rest with a float's ``.0``."""
        key = F.col("p_partkey")
        tmdb = F.concat(F.lit(" "), key.cast("string"), F.lit(".0 "))
        return self.table("part").select(
            key.alias("movieId"), (key * 50000 + 1).cast("string").alias("imdbId"),
            F.when(F.col("p_size") == 50, None).when(F.col("p_size") == 49, "nan")
            .when(F.col("p_size") == 48, "").otherwise(tmdb).alias("tmdbId"),
        )

    def movie(self) -> DataFrame:
        """Every part as a movie; parts of one size have no external id and so are unknown items.

        Parts of some sizes come in threes with one external id, that of one of them.
        """
        key = F.col("p_partkey")
        shared = F.when(F.col("p_size") <= 6, key - key % 3 + 1).otherwise(key)
        return self.table("part").select(
            key.alias("id"), F.col("p_name").alias("title"),
            F.concat(F.lit("tt"), (key * 50000 + 1).cast("string")).alias("imdb_id"),
            F.when(F.col("p_size") != 47, F.concat(shared.cast("string"), F.lit(".0"))).alias("tmdb_id"),
            F.col("p_name").alias("plot"),
        )

    def catalog(self) -> DataFrame:
        details = self.table("part").select(
            F.col("p_partkey").alias("id"), F.array("p_type").alias("genres"), F.array("p_brand").alias("themes"))
        return self.movie().join(details, "id")

    def genre(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    def theme(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))

    def movie_genre(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("movie_id"), F.col("l_suppkey").alias("genre_id"))

    def movie_theme(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("movie_id"), F.col("l_orderkey").alias("theme_id"))

    def history(self) -> DataFrame:
        return export_history(self.raw_ratings(), self.links(), include_rating=True)

    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("item_id"), "text")
