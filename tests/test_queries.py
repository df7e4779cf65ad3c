"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.views import Views
from tastemesh.operators import content, tfidf
from tastemesh.operators.history import interaction_cells
from tastemesh.plans import recommend as R
from tastemesh.sources.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()) is None


def test_listed_users_equal_all_users(spark):
    """Every user, and lists longer than the items with a positive score."""
    v = Views(spark, SF)
    cells = stage(interaction_cells(v.history(), v.catalog()), "cells")
    # One-word vectors, so that many items have nothing in common with a profile.
    vectors = tfidf.top_terms(tfidf.tfidf_vectors(tfidf.item_texts(v.catalog())), 1).drop("rank")
    seen = content.seen_counts(v.history().where("userId % 5 = 0 AND rating > 4.5"), v.catalog())
    jobs = {
        "pearson": (cells, lambda users: R.recommend_pearson(cells, v.catalog(), users)),
        "cosine": (cells, lambda users: R.recommend_cosine(cells, v.catalog(), users)),
        "content": (seen, lambda users: R.recommend_content(vectors, seen, v.catalog(), users, top_k=150)),
    }
    for name, (known, job) in jobs.items():
        users = [r.user_id for r in known.select("user_id").distinct().collect()]
        listed, every = job(users).toPandas(), job(None).toPandas()
        assert difference(listed, every) is None, name
    assert (every["score"] == 0).any()
