"""CSV round trips with awkward text, staged tables, saved vectors."""

import os

import pytest
from pyspark.sql import functions as F

from tastemesh.operators import tfidf
from tastemesh.sources import csv, schemas, staging
from tastemesh.sources.vectors import fingerprint, load_or_build


def test_catalog_csv_keeps_quotes_commas_and_line_breaks(spark, tmp_path):
    rows = [
        (1, 'A "quoted", title', "tt0000001", "862.0", 'line one\nline "two", end', ["Drama", 'O"x'], []),
        (2, "B", None, None, None, [], ["a, b"]),
    ]
    df = spark.createDataFrame(rows, schemas.CATALOG)
    path = str(tmp_path / "catalog")
    csv.write_catalog(df, path)
    back = csv.read_catalog(spark, path)
    assert back.schema == schemas.CATALOG
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_load_inputs_and_history(spark, tmp_path):
    cat, ratings, links = (str(tmp_path / n) for n in ("catalog", "ratings", "links"))
    csv.write_catalog(spark.createDataFrame([(1, "T", "i", "7", "p", [], [])], schemas.CATALOG), cat)
    csv.write_csv(spark.createDataFrame([(1, 2, 3.5)], schemas.RATINGS), ratings)
    csv.write_csv(spark.createDataFrame([(2, "0012", None)], schemas.LINKS), links)
    data = csv.load_inputs(spark, cat, ratings, links)
    assert data.ratings.first().rating == 3.5
    assert tuple(data.links.first()) == (2, "0012", None)
    history = spark.createDataFrame([(1, "tt0000012", "7", 4.0)], schemas.RATED_HISTORY)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"history-{fmt}")
        csv.write_history(history, path, fmt)
        back = csv.read_history(spark, path, rated=True) if fmt == "csv" else spark.read.parquet(path)
        assert [tuple(r) for r in back.collect()] == [(1, "tt0000012", "7", 4.0)]


def test_csv_keeps_blanks(spark, tmp_path):
    rows = [(1, "  padded title ", " i", " 7.0 ", " plot\n ", [" a "], []), (2, "", " ", None, "\n", [], [])]
    for fmt, read in (("csv", csv.read_catalog), ("parquet", csv.read_catalog_parquet)):
        path = str(tmp_path / fmt)
        csv.write_catalog(spark.createDataFrame(rows, schemas.CATALOG), path, fmt=fmt)
        assert sorted(map(tuple, read(spark, path).collect())) == rows


def test_csv_is_read_by_column_name(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("timestamp,movieId,userId,rating\n99,7,1,3.5\n98,8,2,x\n")
    assert [tuple(r) for r in csv.read_ratings(spark, str(path)).collect()] == [(1, 7, 3.5), (2, 8, None)]
    path.write_text("movieId,user,rating\n7,1,3.5\n")
    with pytest.raises(ValueError, match="userId"):
        csv.read_ratings(spark, str(path))


def test_stage_uses_the_shared_folder(spark, monkeypatch, tmp_path):
    numbers = spark.range(5).withColumn("x", F.col("id") * 2)
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    kept = staging.stage(numbers, "numbers")
    assert kept.count() == 5 and str(tmp_path) in kept.inputFiles()[0]
    monkeypatch.setattr(staging, "shared_dir", lambda _: None)
    kept = staging.stage(numbers, "numbers")
    assert kept.is_cached and kept.agg(F.sum("x")).first()[0] == 20
    kept.unpersist()


def test_saved_vectors_follow_their_input(spark, tmp_path):
    root, built = str(tmp_path / "vectors"), []

    def build(items):
        built.append(1)
        return tfidf.tfidf_vectors(items, 10)

    items = spark.createDataFrame([(1, "red cat"), (2, "blue cat")], "item_id long, text string")
    first = load_or_build(items, {"n": 10}, root, build)
    again = load_or_build(items.repartition(3), {"n": 10}, root, build)
    assert len(built) == 1 and first.exceptAll(again).isEmpty()
    load_or_build(items, {"n": 11}, root, build)
    other = items.where("item_id = 1")
    load_or_build(other, {"n": 10}, root, build)
    assert len(built) == 3 and len(os.listdir(root)) == 3
    assert fingerprint(items, {"n": 10}) != fingerprint(other, {"n": 10})
    # What a broken-off job leaves is not taken for saved.
    saved = first.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    os.rename(f"{saved}/_SUCCESS", f"{saved}/_broken")
    load_or_build(items, {"n": 10}, root, build)
    assert len(built) == 4
    shifted = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    other = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    assert fingerprint(shifted, {}) != fingerprint(other, {})
