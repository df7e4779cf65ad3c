"""The helpers inside tasks against plain Python, and block scores against the join on terms."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tastemesh.operators import content, kernels, tfidf


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=20), st.integers(1, 30))
def test_cross(sides, chunk):
    before, kernels._CHUNK = kernels._CHUNK, chunk
    try:
        left_len, length = (np.array(c) for c in zip(*((a, a + b) for a, b in sides)))
        got = [(int(x), int(y)) for li, ri in kernels._cross(left_len, length) for x, y in zip(li, ri)]
    finally:
        kernels._CHUNK = before
    want, start = [], 0
    for a, b in sides:
        want += [(start + x, start + a + y) for x in range(a) for y in range(b)]
        start += a + b
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 39), st.integers(1, 9)), max_size=80), st.integers(1, 100))
def test_sums(entries, chunk):
    before, kernels._CHUNK = kernels._CHUNK, chunk
    try:
        sums = kernels._Sums(40, 2)
        for i in range(0, len(entries), 7):
            part = entries[i:i + 7]
            index = np.array([e[0] for e in part])
            sums.add(index, [np.ones(len(part)), np.array([float(e[1]) for e in part])])
        index, (count, total) = sums.result()
    finally:
        kernels._CHUNK = before
    counts, totals = Counter(), Counter()
    for at, x in entries:
        counts[at] += 1
        totals[at] += x
    assert dict(zip(index.tolist(), count.tolist())) == counts
    assert dict(zip(index.tolist(), total.tolist())) == totals


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 4), st.integers(0, 9))), st.integers(1, 4), st.randoms())
def test_best(pairs, k, rnd):
    pairs = list(pairs)
    rnd.shuffle(pairs)
    strength = np.array([rnd.randint(0, 2) for _ in pairs], dtype=float)
    owner, other = (np.array([p[i] for p in pairs], dtype=int) for i in (0, 1))
    got = {pairs[i] for i in kernels._best(owner, other, strength, k)}
    want = set()
    for u in {p[0] for p in pairs}:
        mine = sorted((-s, p[1]) for p, s in zip(pairs, strength) if p[0] == u)
        want |= {(u, v) for _, v in mine[:k]}
    assert got == want


@pytest.fixture(scope="module")
def skewed(spark):
    """A term that every item has, an item that every user has, an item without terms, equal vectors."""
    rnd = random.Random(11)
    vectors = {(i, "common"): 0.5 for i in range(40)}
    for i in range(30):
        for _ in range(rnd.randint(1, 5)):
            vectors[i, f"t{rnd.randrange(12)}"] = rnd.randint(1, 9) / 10
    seen = {(u, 0): 2 for u in range(25)}
    for u in range(25):
        for _ in range(rnd.randint(0, 4)):
            seen[u, rnd.randrange(41)] = rnd.randint(1, 3)
    seen[99, 40] = 1
    return (
        spark.createDataFrame([(*k, w) for k, w in vectors.items()], "item_id long, term string, weight double"),
        spark.createDataFrame([(*k, n) for k, n in seen.items()], "user_id long, item_id long, times long"),
        spark.createDataFrame([(i, f"title {i % 7}") for i in range(41)], "item_id long, title string"),
    )


def test_blocks_equal_the_join(skewed):
    users = [*range(25), 99]
    joined = {(r.user_id, r.item_id): r.score for r in content.scores_for(*skewed, users).collect()}
    blocks = content.block_scores(*skewed, 100, block_users=7, block_items=9)
    assert {(r.user_id, r.item_id): r.score for r in blocks.collect()} == joined
    positive = content.block_scores(*skewed, 100, include_zero=False, block_users=100, block_items=100)
    assert {(r.user_id, r.item_id): r.score for r in positive.collect()} == {
        pair: s for pair, s in joined.items() if s > 0}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_of_blocks(skewed, k):
    catalog = skewed[2].withColumnRenamed("item_id", "id")
    every = content.rank_content(content.scores_for(*skewed, [*range(25), 99]), catalog, k)
    best = content.rank_content(content.block_scores(*skewed, k, block_users=7, block_items=9), catalog, k)
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.score) for r in df.collect())
    assert key(best) == key(every)


def test_whole_ranking_without_shuffled_rows(spark, skewed, monkeypatch):
    """Ranks formed where the items are held equal those over ranges, and no stage or exchange gets the rows of the result."""
    catalog = skewed[2].withColumnRenamed("item_id", "id").unionByName(
        spark.createDataFrame([(50, None), (51, "title 3")], "id long, title string"))
    seen = skewed[1].unionByName(spark.createDataFrame([(7, 777, 1), (98, 777, 1)], skewed[1].schema))
    users, real, staged = [*range(25), 98, 99], content.stage, []
    monkeypatch.setattr(content, "stage", lambda df, label: (staged.append(out := real(df, label)), out)[1])
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.score) for r in df.collect())
    got = content.content_score_all(skewed[0], seen, catalog, users)
    assert max(df.count() for df in staged) < 0.5 * 27 * 43
    monkeypatch.setattr(content, "RANKED_ITEMS", 42)
    want = content.content_score_all(skewed[0], seen, catalog, users)
    assert got.columns == want.columns and key(got) == key(want) and got.count() == 27 * 43


def test_catalog_copies_do_not_grow_with_shuffle_partitions(spark, skewed, monkeypatch):
    """The catalog travels to about as many tasks as there are cores; weights that are no whole numbers of 1e-8 travel as they are."""
    catalog = skewed[2].withColumnRenamed("item_id", "id")
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.score) for r in df.collect())
    monkeypatch.setattr(content, "LEAST_TASKS", 3)
    most, before = content._holding_tasks(spark), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * most))
    try:
        for vectors in (skewed[0], skewed[0].withColumn("weight", skewed[0].weight / 3)):
            users = spark.range(6 * most)
            seen = users.selectExpr("id AS user_id", "id % 30 AS item_id", "1L AS times")
            got = content.content_score_all(vectors, seen, catalog, users.selectExpr("id AS user_id"))
            assert got.rdd.getNumPartitions() <= most
            with monkeypatch.context() as ranges:
                ranges.setattr(content, "RANKED_ITEMS", 1)
                assert key(got) == key(content.content_score_all(vectors, seen, catalog, users.selectExpr("id AS user_id")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("third", [False, True])
def test_profiles_formed_where_all_items_are_held(spark, skewed, monkeypatch, third):
    """A user travels as its seen items: no profile is shuffled; also with weights that are no whole numbers and vectors of other items."""
    vectors = skewed[0].withColumn("weight", skewed[0].weight / 3) if third else skewed[0]
    items = skewed[2].where("item_id % 5 != 2").unionByName(spark.createDataFrame([(50, None), (51, "title 3")], skewed[2].schema))
    seen = skewed[1].unionByName(spark.createDataFrame([(7, 777, 1), (98, 777, 1), (98, 2, 5), (97, 2, 1)], skewed[1].schema))
    key = lambda df: sorted((r.user_id, r.item_id, r.score) for r in df.collect())
    with monkeypatch.context() as parts:
        parts.setattr(content, "RANKED_ITEMS", 20)
        parts.setattr(content, "ITEMS_PER_ROW", 4)
        want = key(content.held_scores(vectors, seen, items, 50))
    monkeypatch.setattr(content, "content_profile", None)
    assert key(content.held_scores(vectors, seen, items, 50)) == want
    assert {u for u, _, s in want if s > 0} >= {97, 98}


@pytest.mark.parametrize("include_zero", [True, False])
@pytest.mark.parametrize(("k", "parts"), [(1, 1), (3, 4), (5, 1), (50, 3)])
def test_best_of_held_items(spark, skewed, monkeypatch, k, parts, include_zero):
    """Where items are held in tasks no pair of blocks is formed, and the lists are the same, in however many parts the items are."""
    users, items = [*range(25), 98, 99], skewed[2].unionByName(spark.createDataFrame([(50, None), (51, "title 3")], skewed[2].schema))
    seen = skewed[1].unionByName(spark.createDataFrame([(7, 777, 1), (98, 777, 1)], skewed[1].schema))
    catalog = items.withColumnRenamed("item_id", "id")
    want = content.rank_content(content.scores_for(skewed[0], seen, items, users, include_zero), catalog, k)
    monkeypatch.setattr(content, "_score_pairs", None)
    for name, value in (("ITEMS_PER_ROW", 4), ("RANKED_ITEMS", -(-43 // parts))):
        monkeypatch.setattr(content, name, value)
    monkeypatch.setattr(kernels, "_LIKE", 4)
    monkeypatch.setattr(kernels, "_ALIKE", 2)
    scores = content.block_scores(skewed[0], seen, items, k, include_zero, bounded_from=1)
    key = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.score) for r in df.collect())
    assert scores.count() <= 27 * k * parts
    # Scores without a common term count only with include_zero, and the join gives them only then.
    assert key(content.rank_content(scores, catalog, k)) == key(want)


def test_bounds_leave_out_most_items():
    """Held items: the best of all, ties by place, from few scores."""
    rnd, n, k = np.random.default_rng(3), 6400, 10
    cols = np.stack([np.arange(n) // 64, 100 + np.arange(n) // 8 % 40, 140 + rnd.integers(0, 9, n)], axis=1).astype(np.int32)
    vals, places = rnd.integers(1, 10, (n, 3)) / 10, rnd.permutation(n)
    lists = lambda rows, t: pa.array([list(r) for r in rows], pa.list_(t))
    profiles = [rnd.choice(149, 20, replace=False).astype(np.int32) for _ in range(70)]
    weights, seen = [rnd.integers(1, 10, 20) / 10 for _ in profiles], [rnd.choice(n, 30, replace=False) for _ in profiles]
    held = kernels._LikeItems(k, True, 9)
    held.add(pa.RecordBatch.from_arrays(
        [pa.array([0]), lists([range(n)], pa.int64()), lists([places], pa.int64()), lists([[3] * n], pa.int32()), lists([cols.ravel()], pa.int32()),
         lists([vals.ravel()], pa.float64())], names=["nth", "items", "places", "sizes", "cols", "vals"]))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(70)), lists(profiles, pa.int32()), lists(weights, pa.float64()), lists(seen, pa.int64())], names=["user", "cols", "vals", "places"])
    got = pa.Table.from_batches(held.batches(rows)).to_pylist()
    for u, (terms, weight, hidden) in enumerate(zip(profiles, weights, seen)):
        profile = np.zeros(149)
        profile[terms] = weight
        score = np.floor((profile[cols] * vals).sum(axis=1) / (np.sqrt((vals**2).sum(axis=1)) * np.sqrt((profile**2).sum())) * 1e9 + 0.5) / 1e9
        score[hidden] = -1
        best = np.lexsort((places, -score))[:k]
        assert {r["item_id"]: r["score"] for r in got if r["user_id"] == u} == {i: pytest.approx(score[i], abs=2e-9) for i in best}
    assert held.scored < 0.25 * 70 * n


@pytest.mark.parametrize(("low", "high", "n"), [(1, 3, 40), (1, 3, 10**5), (2, 3, 25), (2, 2, 10**5), (3, 3, 3)])
def test_ngrams_as_numbers_equal_ngrams_as_text(spark, monkeypatch, low, high, n):
    """Also over the borders of the rows that long texts are cut into; no n-gram is formed as text."""
    rnd = random.Random(low + high)
    long = " ".join(rnd.choice(["aa", "bb", "cc", "dd", "éé", "_1", "Aa"]) for _ in range(3 * kernels.WORDS_PER_ROW + 1))
    rare = " ".join(f"w{rnd.randrange(200)}" for _ in range(300))
    texts = [(1, long), (2, rare), (3, None), (4, ""), (5, "aa"), (6, "aa bb"), (7, "aa bb aa bb"), (8, "x - y"), (9, long), (9, "bb cc")]
    items = spark.createDataFrame(texts, "item_id long, text string").repartition(3)

    def both() -> tuple[list, list]:
        vocab = tfidf.vocabulary(items, n, low, high)
        return sorted(map(tuple, vocab.collect())), sorted(map(tuple, tfidf.term_frequencies(items, vocab, min(n, 10**4), low, high).collect()))

    with monkeypatch.context() as strings:
        strings.setattr(tfidf, "_fits", lambda *_: False)
        want = both()
    monkeypatch.setattr(tfidf, "_grams", None)
    assert both() == want and want[0]
