"""Catalog: denormalisation, first row per external id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.functions.ids import normalize_id


def _names_per_movie(bridge: DataFrame, named: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct, sorted, null-free names per movie.

    The bridge is made distinct before the join, and ``collect_set`` combines on the map side, so a
    movie or a name with very many bridge rows does not land in one task row by row.
    """
    links = bridge.select("movie_id", key).distinct()
    names = named.select(F.col("id").alias(key), "name").where(F.col("name").isNotNull())
    return links.join(names, key).groupBy("movie_id").agg(F.sort_array(F.collect_set("name")).alias(out))


def denormalize_catalog(
    movie: DataFrame, genre: DataFrame, theme: DataFrame, movie_genre: DataFrame, movie_theme: DataFrame
) -> DataFrame:
    """One row per movie with its genre and theme names as arrays; ``[]`` when it has none."""
    empty = F.array().cast("array<string>")
    genres = _names_per_movie(movie_genre, genre, "genre_id", "genres")
    themes = _names_per_movie(movie_theme, theme, "theme_id", "themes")
    return (
        movie.join(genres, movie.id == genres.movie_id, "left").drop("movie_id")
        .join(themes, F.col("id") == themes.movie_id, "left").drop("movie_id")
        .select("id", "title", "imdb_id", "tmdb_id", "plot",
                F.coalesce("genres", empty).alias("genres"), F.coalesce("themes", empty).alias("themes"))
    )


def by_title(catalog: DataFrame) -> DataFrame:
    """Catalog in title order, missing titles last."""
    return catalog.orderBy(F.col("title").asc_nulls_last(), "id")


def first_per_external_id(catalog: DataFrame) -> DataFrame:
    """The first catalog row, in title order, of each usable tmdb id.

    Returns ``tmdb_id`` (normalised), ``id``, ``title``, ``imdb_id``.
    """
    # NULL sorts first in a struct, so a flag puts missing titles last.
    order = F.struct(F.col("title").isNull(), F.col("title"), F.col("id"))
    return (
        catalog.select(normalize_id("tmdb_id").alias("tmdb_id"), "id", "title", "imdb_id")
        .where(F.col("tmdb_id").isNotNull())
        .groupBy("tmdb_id")
        .agg(F.min_by(F.struct("id", "title", "imdb_id"), order).alias("first"))
        .select("tmdb_id", "first.*")
    )


def with_metadata(recs: DataFrame, catalog: DataFrame, item: str = "item_id") -> DataFrame:
    """Add ``title``, ``tmdb_id`` and ``imdb_id`` of the first catalog row; ``'?'`` without one."""
    first = first_per_external_id(catalog).select(F.col("tmdb_id").alias(item), "id", "title", "imdb_id")
    found = F.col("id").isNotNull()
    return recs.join(first, item, "left").withColumns({
        "title": F.when(found, F.col("title")).otherwise("?"),
        "imdb_id": F.when(found, F.col("imdb_id")).otherwise("?"),
        "tmdb_id": F.col(item),
    }).drop("id")
