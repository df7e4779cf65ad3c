"""The two whole studies, from the input relations to the tables they report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tastemesh.functions.text import ENGLISH_STOP_WORDS
from tastemesh.operators import consensus, content, tfidf
from tastemesh.operators import history as H
from tastemesh.plans import recommend as R
from tastemesh.sources.csv import Inputs
from tastemesh.sources.staging import stage
from tastemesh.sources.vectors import load_or_build


def collaborative_study(
    inputs: Inputs,
    users: Sequence | None,
    k: int = 50,
    min_ratings: int = 20,
    top_k: int = 500,
    shown: int = 15,
    min_score: float = 3.5,
) -> dict[str, DataFrame]:
    """Pearson and cosine recommendations and what they agree on.

    Returns ``summary``, ``pearson``, ``cosine`` (the first ``shown`` of each), ``counts`` and
    ``consensus``.
    """
    history = H.export_history(inputs.ratings, inputs.links, include_rating=True)
    cells = stage(H.interaction_cells(history, inputs.catalog, min_ratings), "cells")
    pearson = stage(R.recommend_pearson(cells, inputs.catalog, users, k, top_k), "pearson")
    cosine = stage(R.recommend_cosine(cells, inputs.catalog, users, k, top_k), "cosine")
    return {
        "summary": H.dataset_summary(cells),
        "pearson": pearson.where(pearson["rank"] <= shown),
        "cosine": cosine.where(cosine["rank"] <= shown),
        "counts": consensus.consensus_counts(pearson, cosine, min_score),
        "consensus": consensus.consensus(pearson, cosine, min_score),
    }


def content_study(
    inputs: Inputs,
    users: Sequence | None,
    top_k: int = 20,
    max_features: int = 5000,
    low: int = 1,
    high: int = 3,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    vector_root: str | None = None,
) -> dict[str, DataFrame]:
    """Content-based recommendations; with ``vector_root``, vectors are saved below it and used again.

    Returns ``vectors``, ``history``, ``coverage`` and ``recommendations``.
    """
    params = {"max_features": max_features, "low": low, "high": high, "stop_words": tuple(stop_words)}
    texts = tfidf.item_texts(inputs.catalog)

    def build(items: DataFrame) -> DataFrame:
        return tfidf.tfidf_vectors(items, **params)

    vectors = load_or_build(texts, params, vector_root, build) if vector_root else stage(build(texts), "vectors")
    history = H.export_history(inputs.ratings, inputs.links)
    seen = content.seen_counts(history, inputs.catalog)
    coverage = content.history_coverage(history, inputs.catalog)
    return {
        "vectors": vectors,
        "history": R.matched_listing(history, inputs.catalog, users, top_k),
        "coverage": H.for_users(coverage, users),
        "recommendations": R.recommend_content(vectors, seen, inputs.catalog, users, top_k),
    }
