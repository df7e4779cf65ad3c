"""User history: export, cleaning, user-item cells and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemesh.functions.ids import normalize_id, pad_imdb_id
from tastemesh.functions.numeric import clip, scaled, unscaled
from tastemesh.sources.staging import stage


def export_history(ratings: DataFrame, links: DataFrame, include_rating: bool = False) -> DataFrame:
    """Ratings with external ids: ``userId, imdbId, tmdbId`` and, on request, the rating in [0, 5]."""
    ids = links.select(
        "movieId", pad_imdb_id("imdbId").alias("imdbId"), F.coalesce(F.col("tmdbId"), F.lit("")).alias("tmdbId")
    )
    rating = [clip(F.col("rating"), 0.0, 5.0).alias("rating")] if include_rating else []
    return ratings.join(ids, "movieId").select("userId", "imdbId", "tmdbId", *rating)


def usable_history(history: DataFrame) -> DataFrame:
    """Rows with a usable item id: ``user_id, item_id`` and, where there is one, ``rating``."""
    rating = ["rating"] if "rating" in history.columns else []
    return history.select(
        F.col("userId").alias("user_id"), normalize_id("tmdbId").alias("item_id"), *rating
    ).where(F.col("item_id").isNotNull())


def known_items(catalog: DataFrame) -> DataFrame:
    return catalog.select(normalize_id("tmdb_id").alias("item_id")).where(F.col("item_id").isNotNull())


def in_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    return rows.join(known_items(catalog), "item_id", "left_semi")


def _row_counts(rows: DataFrame, label: str, *extra: Column) -> DataFrame:
    """Rows per user and item, staged: raw history is combined on the map side before it is shuffled."""
    return stage(rows.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), *extra), label)


def _per_user(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    return in_catalog(counts, catalog).groupBy("user_id").agg(F.sum("n").alias("n"))


def _per_item(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    # Counted before the catalog is joined: one row per item meets it, however often the item occurs.
    return in_catalog(counts.groupBy("item_id").agg(F.sum("n").alias("n")), catalog)


def _keep_supported(rows: DataFrame, counts: DataFrame, catalog: DataFrame, min_ratings: int) -> DataFrame:
    """Rows of known items whose user and whose item have enough rows of known items.

    Both counts come from the same rows and are applied once, so a kept user may end below the minimum.
    """
    enough = F.col("n") >= min_ratings
    items = _per_item(counts, catalog).where(enough).select("item_id")
    users = _per_user(counts, catalog).where(enough).select("user_id")
    kept = rows.join(items, "item_id", "left_semi").join(users, "user_id", "left_semi")
    return kept.select(rows.columns)


def clean_history(history: DataFrame, catalog: DataFrame, min_ratings: int = 20) -> DataFrame:
    """History rows of known items with enough rows on both sides: ``user_id, item_id[, rating]``."""
    rows = usable_history(history)
    return _keep_supported(rows, _row_counts(rows, "row-counts"), catalog, min_ratings)


# Ratings of one cell are added up to this many decimals, the same in any order.
CELL_DIGITS = 9


def _total_rating() -> Column:
    return unscaled(F.sum(scaled(F.col("rating"), CELL_DIGITS)), CELL_DIGITS).alias("rating")


def rating_cells(rows: DataFrame) -> DataFrame:
    """One row per user and item; repeated ratings of a cell are added up."""
    return rows.groupBy("user_id", "item_id").agg(_total_rating())


def binary_cells(rows: DataFrame) -> DataFrame:
    """One row per user and item with how often it occurs."""
    return rows.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("seen"))


def interaction_cells(history: DataFrame, catalog: DataFrame, min_ratings: int = 20) -> DataFrame:
    """``user_id, item_id, seen`` and, if rated, ``rating`` of the cleaned history.

    Same cells as ``rating_cells`` and ``binary_cells`` over ``clean_history``, without going through
    the rows again: support is counted and applied on cells. Stage the result where several branches read it.
    """
    rows = usable_history(history)
    rating = [_total_rating()] if "rating" in rows.columns else []
    counts = _row_counts(rows, "cells", *rating)
    items = _per_item(counts, catalog).select("item_id", (F.col("n") >= min_ratings).alias("enough"))
    # Cells travel once to their items and once to their users, whose rows are at most the catalog's.
    known = counts.join(items, "item_id").where(F.col("user_id").isNotNull())
    of_user = F.sum("n").over(Window.partitionBy("user_id"))
    cells = known.withColumn("of_user", of_user).where(F.col("enough") & (F.col("of_user") >= min_ratings)).select(counts.columns)
    return cells.withColumn("seen", F.col("n").cast("double")).drop("n")


def support_counts(history: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of known items per user and per item: ``kind, key, n``."""
    counts = _row_counts(usable_history(history), "row-counts")

    def named(kind: str, key: str, sums: DataFrame) -> DataFrame:
        return sums.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "n")

    return named("user", "user_id", _per_user(counts, catalog)).unionByName(
        named("item", "item_id", _per_item(counts, catalog)))


def dataset_summary(cells: DataFrame) -> DataFrame:
    """Number of users, items and stored cells, in one row."""
    return cells.agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
        F.count("*").alias("cells"),
    )


def user_means(cells: DataFrame) -> DataFrame:
    """Mean of the stored ratings per user, explicit zeros included."""
    return cells.groupBy("user_id").agg(F.avg("rating").alias("mean"))


def seen_lists(cells: DataFrame, value: str | None = None) -> DataFrame:
    """Per user the items in id order, alone or with a value, as ``items``.

    A list holds each item once, so it is bounded by the size of the catalog.
    """
    entry = F.struct("item_id", value) if value else F.col("item_id")
    return cells.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("items"))


def for_users(df: DataFrame, users: Sequence | DataFrame | None, key: str = "user_id") -> DataFrame:
    """Rows of the given users (a list or a DataFrame with ``key``); all rows for None."""
    if users is None:
        return df
    if isinstance(users, DataFrame):
        return df.join(users.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(users)))
