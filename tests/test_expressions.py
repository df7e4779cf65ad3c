"""Ids, clipping, text and small history cases."""

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from tastemesh.functions import text as X
from tastemesh.functions.dense import cosine
from tastemesh.functions.ids import normalize_id, pad_imdb_id
from tastemesh.functions.numeric import clip
from tastemesh.operators import catalog as K
from tastemesh.operators import history as H
from tastemesh.plans import recommend as R


def _column(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_id(spark):
    got = _column(spark, [" 862.0 ", "862", "", "nan", None], "string", normalize_id)
    assert got == ["862", "862", None, None, None]


def test_pad_imdb_id(spark):
    got = _column(spark, ["114709", "tt0114709", "10872600", "", None, "7"], "string", pad_imdb_id)
    assert got == ["tt0114709", "tt0114709", "tt10872600", "", "", "tt0000007"]


def test_clip(spark):
    got = _column(spark, [-1.0, 0.0, 4.5, 9.0, None, float("nan")], "double", lambda c: clip(c, 0.0, 5.0))
    assert got == [0.0, 0.0, 4.5, 5.0, None, None]


def test_item_text(spark):
    df = spark.createDataFrame(
        [(1, "A plot", ["Drama", "Comedy"], ["love"]), (2, None, None, None), (3, "", [], []), (4, None, ["X"], None)],
        "i int, plot string, genres array<string>, themes array<string>",
    )
    text = X.item_text(F.col("plot"), F.col("genres"), F.col("themes"))
    assert [r[0] for r in df.orderBy("i").select(text).collect()] == [
        "A plot Drama Comedy love", "unknown", "unknown", "X"]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("The Cat's été, x_1 and a DOG!",)], "text string").select(
        X.tokens(F.col("text")).alias("t"))
    assert df.first().t == ["cat", "été", "x_1", "dog"]
    runs = df.select(F.inline(X.word_runs(F.col("t"), 3)))
    grams = runs.select(F.explode(X.run_ngrams([F.col("w1"), F.col("w2"), F.col("w3")], 1, 3)).alias("g"))
    assert sorted(r.g for r in grams.collect()) == sorted([
        "cat", "été", "x_1", "dog", "cat été", "été x_1", "x_1 dog", "cat été x_1", "été x_1 dog"])


def test_stop_words_are_the_usable_default_ones(spark):
    usable = {w for w in StopWordsRemover.loadDefaultStopWords("english") if len(w) > 1 and w.isalpha()}
    assert usable == set(X.ENGLISH_STOP_WORDS)


def test_dense_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.5**0.5), 0.0]


def _catalog(spark, rows):
    return spark.createDataFrame(
        rows, "id long, title string, imdb_id string, tmdb_id string, plot string, genres array<string>, "
        "themes array<string>")


def test_first_row_per_external_id(spark):
    cat = _catalog(spark, [
        (1, None, "a", "7.0", None, [], []), (2, "B", "b", "7", None, [], []), (3, "B", "c", " 7 ", None, [], []),
        (4, "A", "d", None, None, [], []), (5, "C", "e", "nan", None, [], []),
    ])
    rows = K.first_per_external_id(cat).collect()
    assert [(r.tmdb_id, r.id, r.title, r.imdb_id) for r in rows] == [("7", 2, "B", "b")]
    recs = spark.createDataFrame([("7",), ("8",)], "item_id string")
    got = {r.item_id: (r.title, r.imdb_id) for r in K.with_metadata(recs, cat).collect()}
    assert got == {"7": ("B", "b"), "8": ("?", "?")}


def test_denormalize_catalog(spark):
    movie = spark.createDataFrame(
        [(1, "B", "i", "t", "p"), (2, None, None, None, None), (3, "A", "i", "t", "p")],
        "id long, title string, imdb_id string, tmdb_id string, plot string")
    genre = spark.createDataFrame([(1, "Drama"), (2, "Comedy"), (3, None)], "id long, name string")
    theme = spark.createDataFrame([(1, "love"), (2, "love")], "id long, name string")
    mg = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3)], "movie_id long, genre_id long")
    mt = spark.createDataFrame([(1, 1), (1, 2)], "movie_id long, theme_id long")
    rows = K.by_title(K.denormalize_catalog(movie, genre, theme, mg, mt)).collect()
    assert [(r.id, r.genres, r.themes) for r in rows] == [
        (3, [], []), (1, ["Comedy", "Drama"], ["love"]), (2, [], [])]


def _history(spark, rows):
    return spark.createDataFrame(rows, "userId long, imdbId string, tmdbId string, rating double")


def test_support_is_counted_once(spark):
    # User 1 has two rows, one of an item that only that user has: the user stays, with one cell.
    history = _history(spark, [
        (1, "", "10", 4.0), (1, "", "11", 3.0), (2, "", "10", 5.0), (2, "", "10.0", 4.0), (3, "", "10", 1.0),
        (2, "", "99", 1.0), (2, "", "nan", 1.0), (2, "", None, 1.0),
    ])
    cat = _catalog(spark, [(i, "t", "i", str(i), None, [], []) for i in (10, 11)])
    clean = H.clean_history(history, cat, min_ratings=2)
    assert sorted((r.user_id, r.item_id, r.rating) for r in clean.collect()) == [
        (1, "10", 4.0), (2, "10", 4.0), (2, "10", 5.0)]
    cells = H.interaction_cells(history, cat, min_ratings=2)
    assert sorted((r.user_id, r.item_id, r.rating, r.seen) for r in cells.collect()) == [
        (1, "10", 4.0, 1.0), (2, "10", 9.0, 2.0)]
    assert H.rating_cells(clean).join(H.binary_cells(clean), ["user_id", "item_id"]).exceptAll(
        cells.select("user_id", "item_id", "rating", "seen")).isEmpty()
    unrated = H.interaction_cells(history.drop("rating"), cat, min_ratings=2)
    assert unrated.columns == ["user_id", "item_id", "seen"]


def test_unknown_user_and_empty_result(spark):
    cells = spark.createDataFrame([(1, "a", 4.0, 1.0)], "user_id long, item_id string, rating double, seen double")
    cat = _catalog(spark, [(1, "t", "i", "a", None, [], [])])
    for job in (R.recommend_pearson, R.recommend_cosine):
        with pytest.raises(ValueError, match=r"\[2, 3\]"):
            job(cells, cat, [1, 2, 3], require_known=True)
        assert job(cells, cat, [2]).count() == 0
        empty = job(cells, cat, [1])
        assert empty.columns[:6] == list(R.OUTPUT) and empty.count() == 0
        assert job(cells, cat, [2, 3]).count() == 0
        assert job(cells, cat).count() == 0
    with pytest.raises(ValueError):
        R.history_listing(cells, cat, [2], require_known=True)
