"""Explicit schemas of the input and output relations; external ids are strings."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_LONG, _TEXT, _DOUBLE = T.LongType(), T.StringType(), T.DoubleType()
_LIST = T.ArrayType(_TEXT)

MOVIE = _schema(id=_LONG, title=_TEXT, imdb_id=_TEXT, tmdb_id=_TEXT, plot=_TEXT)
NAMED = _schema(id=_LONG, name=_TEXT)
MOVIE_GENRE = _schema(movie_id=_LONG, genre_id=_LONG)
MOVIE_THEME = _schema(movie_id=_LONG, theme_id=_LONG)
CATALOG = T.StructType([*MOVIE.fields, T.StructField("genres", _LIST), T.StructField("themes", _LIST)])
RATINGS = _schema(userId=_LONG, movieId=_LONG, rating=_DOUBLE)
LINKS = _schema(movieId=_LONG, imdbId=_TEXT, tmdbId=_TEXT)
HISTORY = _schema(userId=_LONG, imdbId=_TEXT, tmdbId=_TEXT)
RATED_HISTORY = _schema(userId=_LONG, imdbId=_TEXT, tmdbId=_TEXT, rating=_DOUBLE)
