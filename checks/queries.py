"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Views
from tastemesh.functions.ids import normalize_id, pad_imdb_id
from tastemesh.functions.numeric import clip, quantize
from tastemesh.operators import consensus as C
from tastemesh.operators import content, dense, prediction, similarity, tfidf
from tastemesh.operators import history as H
from tastemesh.operators.catalog import by_title, denormalize_catalog, first_per_external_id
from tastemesh.operators.incremental import VectorStore
from tastemesh.plans import recommend as R
from tastemesh.sources import csv
from tastemesh.sources.staging import stage
from tastemesh.sources.vectors import load_or_build

USER = 10
# Whole rows of tables are asked for by every user whose id it divides, against all users or items.
EVERY = 100
COLLABORATIVE_TOP = 500
CONTENT_TOP = 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register under the function's name, without the underscore that keeps it off an import."""
    QUERIES[f.__name__.rstrip("_")] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def _sink(v: Views, label: str) -> str:
    """A new folder below the warehouse, which the cluster shares."""
    return f"{v.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _cells(v: Views) -> DataFrame:
    return H.interaction_cells(v.history(), v.catalog())


def _asking(rows: DataFrame) -> DataFrame:
    return rows.select("user_id").distinct().where(F.col("user_id") % EVERY == 0)


def _kept_cells(v: Views) -> DataFrame:
    return stage(_cells(v), "cells")


# --- sources and sinks -----------------------------------------------------------------------


@query
def csv_catalog_roundtrip(v: Views) -> DataFrame:
    path = _sink(v, "catalog-csv")
    csv.write_catalog(v.catalog(), path)
    return _joined_lists(csv.read_catalog(v.spark, path))


@query
def csv_ratings_roundtrip(v: Views) -> DataFrame:
    path = _sink(v, "ratings-csv")
    csv.write_csv(v.ratings(), path)
    return csv.read_ratings(v.spark, path)


@query
def csv_links_roundtrip(v: Views) -> DataFrame:
    path = _sink(v, "links-csv")
    csv.write_csv(v.links(), path)
    return csv.read_links(v.spark, path)


@query
def csv_history_roundtrip(v: Views) -> DataFrame:
    path = _sink(v, "history-csv")
    csv.write_history(v.history(), path, fmt="csv")
    return csv.read_history(v.spark, path, rated=True)


@query
def parquet_catalog_roundtrip(v: Views) -> DataFrame:
    path = _sink(v, "catalog-parquet")
    csv.write_catalog(v.catalog(), path, fmt="parquet")
    return _joined_lists(csv.read_catalog_parquet(v.spark, path))


@query
def vector_store_roundtrip(v: Views) -> DataFrame:
    params = {"max_features": 5000, "low": 1, "high": 3}
    root = _sink(v, "vector-store")

    def saved() -> DataFrame:
        return load_or_build(
            tfidf.item_texts(v.catalog()), params, root, lambda items: tfidf.tfidf_vectors(items, **params))

    saved()
    return _rounded(saved())


# --- projections, cleaning -------------------------------------------------------------------


@query
def normalize_id_(v: Views) -> DataFrame:
    return v.links().select("movieId", normalize_id("tmdbId").alias("tmdb_id"))


@query
def pad_imdb_id_(v: Views) -> DataFrame:
    return v.links().select("movieId", pad_imdb_id("imdbId").alias("imdb_id"))


@query
def clip_rating(v: Views) -> DataFrame:
    return v.raw_ratings().select("userId", "movieId", "rating", clip(F.col("rating"), 0.0, 5.0).alias("clipped"))


@query
def export_history(v: Views) -> DataFrame:
    return H.export_history(v.raw_ratings(), v.links())


@query
def export_history_rated(v: Views) -> DataFrame:
    return H.export_history(v.raw_ratings(), v.links(), include_rating=True)


@query
def clean_history(v: Views) -> DataFrame:
    return H.clean_history(v.history(), v.catalog())


@query
def support_counts(v: Views) -> DataFrame:
    return H.support_counts(v.history(), v.catalog())


@query
def rating_cells(v: Views) -> DataFrame:
    return H.rating_cells(H.clean_history(v.history(), v.catalog()))


@query
def binary_cells(v: Views) -> DataFrame:
    return H.binary_cells(H.clean_history(v.history(), v.catalog()))


@query
def interaction_cells(v: Views) -> DataFrame:
    return _cells(v).select("user_id", "item_id", "rating", "seen")


@query
def dataset_summary(v: Views) -> DataFrame:
    return H.dataset_summary(_cells(v))


@query
def user_means(v: Views) -> DataFrame:
    return H.user_means(_cells(v)).withColumn("mean", quantize(F.col("mean"), 6))


@query
def seen_lists(v: Views) -> DataFrame:
    lists = H.seen_lists(_cells(v), "rating")
    entry = F.transform("items", lambda e: F.concat_ws(":", e["item_id"], F.round(e["rating"] * 10).cast("int").cast("string")))
    return lists.select("user_id", F.array_join(entry, "|").alias("items"))


@query
def catalog_denorm(v: Views) -> DataFrame:
    denormalized = denormalize_catalog(v.movie(), v.genre(), v.theme(), v.movie_genre(), v.movie_theme())
    return by_title(_joined_lists(denormalized))


@query
def catalog_first(v: Views) -> DataFrame:
    return first_per_external_id(v.catalog())


# --- collaborative filtering -----------------------------------------------------------------


@query
def pearson_neighbors(v: Views) -> DataFrame:
    return similarity.pearson_neighbors(_kept_cells(v), [USER])


@query
def cosine_neighbors(v: Views) -> DataFrame:
    return similarity.cosine_neighbors(_kept_cells(v), [USER])


@query
def pearson_neighbors_batch(v: Views) -> DataFrame:
    return similarity.pearson_neighbors(_kept_cells(v))


@query
def cosine_neighbors_batch(v: Views) -> DataFrame:
    return similarity.cosine_neighbors(_kept_cells(v))


@query
def pearson_matrix(v: Views) -> DataFrame:
    cells = _kept_cells(v)
    return similarity.pearson_matrix(cells, _asking(cells))


@query
def cosine_matrix(v: Views) -> DataFrame:
    cells = _kept_cells(v)
    return similarity.cosine_matrix(cells, _asking(cells))


def _dense(v: Views, matrix, empty: float | None) -> DataFrame:
    cells = _kept_cells(v)
    index, users = similarity.user_index(cells), _asking(cells)
    return similarity.dense_matrix(similarity.packed_matrix(matrix(cells, users), index), index, users, empty)


@query
def pearson_matrix_dense(v: Views) -> DataFrame:
    return _dense(v, similarity.pearson_matrix, None)


@query
def cosine_matrix_dense(v: Views) -> DataFrame:
    return _dense(v, similarity.cosine_matrix, 0.0)


@query
def pearson_predict_all(v: Views) -> DataFrame:
    cells = _kept_cells(v)
    neighbors = stage(similarity.pearson_neighbors(cells, _asking(cells), k=None), "neighbors")
    scores = prediction.predict_pearson(cells, neighbors, _asking(cells), bounds=None, digits=2)
    return prediction.rank_items(scores, None).drop("support")


@query
def cosine_predict_all(v: Views) -> DataFrame:
    cells = _kept_cells(v)
    neighbors = stage(similarity.cosine_neighbors(cells, _asking(cells), k=None), "neighbors")
    scores = prediction.predict_cosine(cells, neighbors, _asking(cells), digits=3)
    return prediction.rank_items(scores, None).drop("support")


def _pearson(v: Views, cells: DataFrame, users=(USER,), top_k=COLLABORATIVE_TOP) -> DataFrame:
    return R.recommend_pearson(cells, v.catalog(), users, top_k=top_k)


def _cosine(v: Views, cells: DataFrame, users=(USER,), top_k=COLLABORATIVE_TOP) -> DataFrame:
    return R.recommend_cosine(cells, v.catalog(), users, top_k=top_k)


@query
def rec_pearson(v: Views) -> DataFrame:
    return _pearson(v, _kept_cells(v))


@query
def rec_cosine(v: Views) -> DataFrame:
    return _cosine(v, _kept_cells(v))


@query
def rec_pearson_batch(v: Views) -> DataFrame:
    return _pearson(v, _kept_cells(v), None, 10)


@query
def rec_cosine_batch(v: Views) -> DataFrame:
    return _cosine(v, _kept_cells(v), None, 10)


def _both(v: Views) -> tuple[DataFrame, DataFrame]:
    cells = _kept_cells(v)
    return _pearson(v, cells), _cosine(v, cells)


@query
def rec_consensus(v: Views) -> DataFrame:
    return C.consensus(*_both(v))


@query
def consensus_ids(v: Views) -> DataFrame:
    return C.consensus_ids(*_both(v))


@query
def consensus_counts(v: Views) -> DataFrame:
    return C.consensus_counts(*_both(v))


@query
def user_history(v: Views) -> DataFrame:
    return R.matched_listing(v.history(), v.catalog(), top_k=10)


@query
def user_history_rated(v: Views) -> DataFrame:
    return R.history_listing(_cells(v), v.catalog(), rated=True)


@query
def user_history_titles(v: Views) -> DataFrame:
    return R.history_listing(_cells(v), v.catalog())


@query
def history_coverage(v: Views) -> DataFrame:
    return content.history_coverage(v.history(), v.catalog())


# --- text vectors and content-based recommendations ------------------------------------------


def _joined_lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in ("genres", "themes")})


def _rounded(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("weight", quantize(F.col("weight"), 6))


def _catalog_vectors(v: Views) -> DataFrame:
    return stage(tfidf.tfidf_vectors(tfidf.item_texts(v.catalog())), "vectors")


@query
def item_text(v: Views) -> DataFrame:
    return tfidf.item_texts(v.catalog())


@query
def tokens(v: Views) -> DataFrame:
    return tfidf.tokenized(v.texts()).select(
        "item_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query
def ngrams(v: Views) -> DataFrame:
    return tfidf.ngram_counts(v.texts())


@query
def tfidf_vocab(v: Views) -> DataFrame:
    vocab = stage(tfidf.vocabulary(v.texts()), "vocabulary")
    return tfidf.document_frequencies(tfidf.term_frequencies(v.texts(), vocab, 5000))


@query
def tfidf_vectors(v: Views) -> DataFrame:
    return _rounded(tfidf.tfidf_vectors(v.texts()))


@query
def tfidf_incremental(v: Views) -> DataFrame:
    """The vectors of all texts, from a store that first held an earlier state of the table.

    Of a hundredth of the texts the store held other words, another hundredth is new and some are gone.
    """
    texts = v.texts()
    part = F.pmod("item_id", F.lit(100))
    before = texts.where(part != 1).withColumn("text", F.when(part == 2, F.reverse("text")).otherwise(F.col("text")))
    gone = texts.where(part == 3).withColumn("item_id", -F.col("item_id") - 1)
    store = VectorStore(v.spark, _sink(v, "vector-store"))
    store.update(before.unionByName(gone))
    store.update(texts)
    return _rounded(store.vectors())


@query
def top_terms(v: Views) -> DataFrame:
    return _rounded(tfidf.top_terms(tfidf.tfidf_vectors(v.texts())))


@query
def vector_stats(v: Views) -> DataFrame:
    return tfidf.vector_stats(tfidf.tfidf_vectors(v.texts())).withColumn(
        "weight_sum", quantize(F.col("weight_sum"), 4))


@query
def content_profile(v: Views) -> DataFrame:
    return _rounded(content.content_profile(_catalog_vectors(v), content.seen_counts(v.history(), v.catalog())))


@query
def content_score_all(v: Views) -> DataFrame:
    seen = content.seen_counts(v.history(), v.catalog())
    scores = content.content_score_all(_catalog_vectors(v), seen, v.catalog(), _asking(seen))
    return scores.select("user_id", "item_id", quantize(F.col("score"), 4).alias("score"), "rank")


def _content(v: Views, users, top_k: int) -> DataFrame:
    seen = content.seen_counts(v.history(), v.catalog())
    return R.recommend_content(_catalog_vectors(v), seen, v.catalog(), users, top_k)


@query
def rec_content(v: Views) -> DataFrame:
    return _content(v, [USER], CONTENT_TOP)


@query
def rec_content_batch(v: Views) -> DataFrame:
    return _content(v, None, 10)


@query
def vector_mean(v: Views) -> DataFrame:
    means = dense.vector_mean(v.table("embeddings"), "label")
    return means.select("label", F.posexplode("mean").alias("pos", "x")).select(
        "label", "pos", quantize(F.col("x"), 6).alias("mean"))


@query
def vector_cosine(v: Views) -> DataFrame:
    return dense.cosine_with_mean(v.table("embeddings"), "label").select(
        "vec_id", "label", quantize(F.col("cosine"), 6).alias("cosine"))
