"""The vector store against full builds."""

import random

import pytest
from pyspark.sql import functions as F

from tastemesh.operators import tfidf
from tastemesh.operators.incremental import VectorStore

SCHEMA = "item_id long, text string"


def _texts(rnd, ids, words=60):
    return {i: " ".join(f"w{min(int(rnd.expovariate(0.08)), words)}" for _ in range(rnd.randint(0, 25))) for i in ids}


def _frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), SCHEMA)


def _rows(df):
    return {(r.item_id, r.term): round(r.weight, 7) for r in df.collect()}


def _written(spark, store, state, table):
    return spark.read.parquet(f"{store.folder}/gen-{state.gen:09d}/{table}")


@pytest.mark.parametrize("low, high", [(1, 3), (2, 2)])
def test_updates_equal_full_builds(spark, tmp_path, low, high):
    rnd = random.Random(high)
    texts = _texts(rnd, range(60))
    store = VectorStore(spark, str(tmp_path), 30, low, high)
    assert store.update(_frame(spark, texts)).base == 0
    for step in range(2):
        # Some items are added, some change and some go; one word becomes frequent and later rare again.
        for i in rnd.sample(sorted(texts), 3):
            del texts[i]
        texts.update(_texts(rnd, rnd.sample(sorted(texts), 3)))
        texts.update(_texts(rnd, range(100 + 5 * step, 105 + 5 * step)))
        texts[7] = "brandnew thing " * 20 if step == 0 else "red"
        state = store.update(_frame(spark, texts))
        expected = _rows(tfidf.tfidf_vectors(_frame(spark, texts), 30, low, high))
        assert _rows(store.vectors()) == expected, step
        assert state.n == len(texts)


def test_only_what_changed_is_written(spark, tmp_path):
    # Totals far enough apart for the list to stay as it is but for what enters on purpose.
    texts = {i: " ".join(f"w{k:02d}" for k in range(40) if i % (k + 1) == 0) for i in range(400)}
    store = VectorStore(spark, str(tmp_path), 10, 1, 1, ())
    first = store.update(_frame(spark, texts))
    assert (first.gen, first.rewritten) == (0, 400)
    assert store.update(_frame(spark, texts).repartition(5)) == first
    texts |= {400: "w00 w03", 401: "w00", 5: "w00 w01"}
    second = store.update(_frame(spark, texts))
    assert (second.gen, second.base, second.rewritten) == (1, 0, 3)
    assert {r.item_id for r in _written(spark, store, second, "counts").collect()} == {400, 401, 5}
    # A word from outside the reserve that enters is looked for in all texts.
    texts[402] = "w35 " * 60
    third = store.update(_frame(spark, texts))
    assert (third.base, third.rewritten) == (0, 1)
    written = {(r.item_id, r.term) for r in _written(spark, store, third, "counts").collect()}
    assert written == {(i, "w35") for i in texts if "w35" in texts[i]} and len(written) > 5
    assert _rows(store.vectors()) == _rows(tfidf.tfidf_vectors(_frame(spark, texts), 10, 1, 1, ()))
    # It leaves and comes back: rows of its first time do not count.
    texts[402] = "w00"
    store.update(_frame(spark, texts))
    texts |= {35: "w00", 402: "w35 " * 60}
    last = store.update(_frame(spark, texts))
    assert last.base == 0
    assert _rows(store.vectors()) == _rows(tfidf.tfidf_vectors(_frame(spark, texts), 10, 1, 1, ()))


def test_broken_off_updates_and_new_tables(spark, tmp_path):
    texts = {i: f"a{'b' * (i % 4 + 1)} cc" for i in range(50)}
    store = VectorStore(spark, str(tmp_path), 3, 1, 1, ())
    store.update(_frame(spark, texts))
    texts[0] = "cc cc"
    # An update that wrote its tables but no state.
    store._write(1, "items", _frame(spark, {0: "wrong"}).selectExpr("item_id", "text", "'x' AS print", "true AS live", "1 AS gen"))
    assert store.state().gen == 0
    assert store.update(_frame(spark, texts)).gen == 1
    assert _rows(store.vectors()) == _rows(tfidf.tfidf_vectors(_frame(spark, texts), 3, 1, 1, ()))
    # Most items new: built anew.
    texts = {i: "dd ee" for i in range(100, 140)}
    state = store.update(_frame(spark, texts))
    assert state.base == state.gen == 2
    assert {r[1] for r in _rows(store.vectors())} == {"dd", "ee"}


def test_odd_items(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), 5, 1, 1, ())
    with pytest.raises(ValueError):
        store.vectors()
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            store.update(spark.createDataFrame(rows, SCHEMA))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "aa bb"), (4, "aa")], SCHEMA)
    assert store.update(odd.withColumn("gen", F.lit("x"))).n == 4
    assert _rows(store.vectors()) == _rows(tfidf.tfidf_vectors(odd, 5, 1, 1, ()))
    assert store.update(spark.createDataFrame([], SCHEMA)).n == 0
    assert store.vectors().isEmpty()
    # Other parameters are another store.
    assert VectorStore(spark, str(tmp_path), 6, 1, 1, ()).state() is None
