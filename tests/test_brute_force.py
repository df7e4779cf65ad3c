"""Similarity, prediction and vocabulary against plain Python on small, skewed inputs."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastemesh.functions.text import ENGLISH_STOP_WORDS
from tastemesh.operators import content, prediction, ranking, similarity, tfidf


def _skewed_cells(seed, n_users=60, n_items=40):
    """One item that every user has, one user who has every item, some zeros and doubled cells."""
    rnd = random.Random(seed)
    cells = {}
    for u in range(n_users):
        cells[u, "hot"] = (float(rnd.randint(1, 10)) / 2, 1.0)
        for _ in range(rnd.randint(0, 3)):
            cells[u, f"i{rnd.randrange(n_items)}"] = (float(rnd.randint(0, 10)) / 2, float(rnd.randint(1, 2)))
    for i in range(n_items):
        cells[7, f"i{i}"] = (float(rnd.randint(1, 10)) / 2, 1.0)
    for i in range(6):
        cells[8, f"i{i}"] = (3.0, 1.0)
    return cells


def _pearson(a, b):
    common = [i for i in a if i in b and a[i] > 0 and b[i] > 0]
    if len(common) < 2:
        return None
    mx, my = (sum(v[i] for i in common) / len(common) for v in (a, b))
    vx, vy = sum((a[i] - mx) ** 2 for i in common), sum((b[i] - my) ** 2 for i in common)
    if vx < 1e-12 or vy < 1e-12:
        return None
    return sum((a[i] - mx) * (b[i] - my) for i in common) / math.sqrt(vx * vy)


def _cosine(a, b):
    dot = sum(a[i] * b[i] for i in a if i in b)
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else None


def _expected(cells, which, k):
    rows = defaultdict(dict)
    for (u, i), value in cells.items():
        rows[u][i] = value[which]
    sim = _cosine if which else _pearson
    out = {}
    for u in rows:
        pairs = [(v, sim(rows[u], rows[v])) for v in rows if v != u]
        pairs = [(v, round(s, 7)) for v, s in pairs if s is not None]
        pairs.sort(key=lambda p: (-(p[1] if which else abs(p[1])), p[0]))
        out[u] = pairs[:k]
    return rows, {u: p for u, p in out.items() if p}


@pytest.mark.parametrize("which, job", [(0, similarity.pearson_neighbors), (1, similarity.cosine_neighbors)])
@pytest.mark.parametrize("block_users", [None, 2, 17])
def test_neighbors(spark, which, job, block_users):
    cells = _skewed_cells(3)
    df = spark.createDataFrame([(u, i, *v) for (u, i), v in cells.items()],
                               "user_id long, item_id string, rating double, seen double")
    _, want = _expected(cells, which, 5)
    for users in (None, list(range(60))):
        got = defaultdict(list)
        for r in job(df, users, 5, block_users or 1024).orderBy("user_id", "rank").collect():
            got[r.user_id].append((r.other_id, round(r.sim, 7)))
        assert got == want


def test_hot_items_are_cut_into_groups(spark, monkeypatch):
    cells = _skewed_cells(3)
    df = spark.createDataFrame([(u, i, *v) for (u, i), v in cells.items()],
                               "user_id long, item_id string, rating double, seen double")
    want = {tuple(r) for r in similarity.cosine_neighbors(df, k=9).collect()}
    monkeypatch.setattr(similarity, "BLOCKS_PER_GROUP", 2)
    assert {tuple(r) for r in similarity.cosine_neighbors(df, k=9, block_users=4).collect()} == want


def test_predictions(spark):
    cells = _skewed_cells(5)
    df = spark.createDataFrame([(u, i, *v) for (u, i), v in cells.items()],
                               "user_id long, item_id string, rating double, seen double")
    rows, neighbors = _expected(cells, 0, 6)
    means = {u: sum(r.values()) / len(r) for u, r in rows.items()}
    want = {}
    for u, near in neighbors.items():
        for item in {i for v, _ in near for i in rows[v]} - set(rows[u]):
            rated = [(v, s) for v, s in near if rows[v].get(item)]
            den = sum(abs(s) for _, s in rated)
            if den:
                score = means[u] + sum(s * (rows[v][item] - means[v]) for v, s in rated) / den
                want[u, item] = min(5.0, max(0.0, score))
    near = similarity.pearson_neighbors(df, None, 6)
    got = {(r.user_id, r.item_id): r.score for r in prediction.predict_pearson(df, near).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.01e-4 for k in want)
    some = prediction.predict_pearson(df, similarity.pearson_neighbors(df, [3, 9], 6), [3, 9])
    assert {(r.user_id, r.item_id): r.score for r in some.collect()} == {
        k: s for k, s in got.items() if k[0] in (3, 9)}


def _cells_frame(spark, cells):
    return spark.createDataFrame([(u, i, r, 1.0) for (u, i), r in cells.items()],
                                 "user_id long, item_id string, rating double, seen double")


def _both_paths(df, users, k):
    for listed in (users, None):
        yield {(r.user_id, r.other_id): r.sim for r in similarity.pearson_neighbors(df, listed, k).collect()}


def test_constant_raters_have_no_correlation(spark):
    cells = {(u, f"i{i}"): r for u, r in ((1, 3.9), (2, 3.7), (3, 1.1)) for i in range(8)}
    cells.update({(4, f"i{i}"): 0.5 + 0.5 * i for i in range(8)})
    cells.update({(5, f"i{i}"): 4.3 - 0.4 * i for i in range(8)})
    for got in _both_paths(_cells_frame(spark, cells), [1, 2, 3, 4, 5], 10):
        assert got == {(4, 5): -1.0, (5, 4): -1.0}


def test_ratings_in_tenths(spark):
    rnd = random.Random(17)
    cells = {(u, f"i{i}"): rnd.randint(0, 50) / 10 for u in range(20) for i in range(12) if rnd.random() < 0.7}
    rows = defaultdict(dict)
    for (u, i), r in cells.items():
        rows[u][i] = r
    want = {(u, v): s for u in rows for v in rows if u != v and (s := _pearson(rows[u], rows[v])) is not None}
    for got in _both_paths(_cells_frame(spark, cells), list(range(20)), 100):
        assert got.keys() == want.keys()
        assert all(abs(got[p] - want[p]) < 1e-9 and abs(got[p]) <= 1 for p in want)


def test_matrix_rows(spark):
    cells = _skewed_cells(9)
    df = spark.createDataFrame([(u, i, *v) for (u, i), v in cells.items()],
                               "user_id long, item_id string, rating double, seen double")
    rows, binary = defaultdict(dict), defaultdict(dict)
    for (u, i), (r, s) in cells.items():
        binary[u][i] = s
        if r > 0:
            rows[u][i] = r
    users = [3, 7, 8]
    for job, table, sim in ((similarity.pearson_matrix, rows, _pearson), (similarity.cosine_matrix, binary, _cosine)):
        want = {(u, v): 1.0 if u == v else sim(table[u], table[v]) for u in users for v in table
                if set(table[u]) & set(table[v])}
        got = {(r.user_id, r.other_id): r.sim for r in job(df, users).collect()}
        assert got.keys() == want.keys()
        assert all(got[p] == s if s is None else abs(got[p] - s) < 1e-9 for p, s in want.items())


def _dense_case(spark, seed):
    cells = _skewed_cells(seed)
    return spark.createDataFrame([(u, i, *v) for (u, i), v in cells.items()], "user_id long, item_id string, rating double, seen double")


@pytest.mark.parametrize("job, empty", [(similarity.pearson_matrix, None), (similarity.cosine_matrix, 0.0)])
def test_dense_matrix_adds_the_complement(spark, job, empty):
    """Every pair of the users asked for, empty where they share nothing; empty parts are not stored."""
    df = _dense_case(spark, 9)
    lonely = spark.createDataFrame([(10**6, "nobody else has this", 3.0, 1.0)], df.schema)
    cells = df.unionByName(lonely)
    users, index = [3, 7, 8, 10**6], similarity.user_index(cells)
    everyone = sorted(r.user_id for r in cells.select("user_id").distinct().collect())
    assert [r.user_id for r in index.orderBy("pos").collect()] == everyone
    rows = {(r.user_id, r.other_id): r.sim for r in job(cells, users).collect()}
    packed = similarity.packed_matrix(job(cells, users), index)
    assert sum(len(r.pos) for r in packed.collect()) == sum(x is not None for x in rows.values())
    got = {(r.user_id, r.other_id): (r.sim, r.met) for r in similarity.dense_matrix(packed, index, users, empty).collect()}
    assert got == {(u, o): (rows.get((u, o), empty), (u, o) in rows) for u in users for o in everyone}


def test_whole_ranks_of_a_hot_key(spark):
    """Numbers equal those of a window, and no range holds the hot key whole."""
    rows = [(1 if i % 3 else i, (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, score long, item_id long")
    order = [F.col("score").desc(), F.col("item_id")]
    want = {(r.user_id, r.item_id): r["rank"] for r in ranking.ranked(df, ["user_id"], order).collect()}
    assert {(r.user_id, r.item_id): r["rank"] for r in ranking.whole_ranks(df, ["user_id"], order).collect()} == want
    flat = ranking.whole_ranks(df, [], [F.col("item_id").desc()], "place").collect()
    assert {r.item_id: r.place for r in flat} == {i: 3000 - i for i in range(3000)}
    assert ranking.whole_ranks(df.where("false"), ["user_id"], order).count() == 0


def test_blocks_without_common_items_are_not_worked_on(spark, monkeypatch):
    """Groups of users with items of their own: headers are made for pairs of blocks that meet, not for all."""
    counted, real = {}, similarity.stage

    def counting(df, label):
        out = real(df, label)
        counted[label] = out
        return out

    monkeypatch.setattr(similarity, "stage", counting)
    cells = {(u, f"{u // 4}-{i}"): float(1 + (u * i) % 5) for u in range(80) for i in range(5)}
    got = {(r.user_id, r.other_id) for r in similarity.cosine_neighbors(_cells_frame(spark, cells), None, 10, 2).collect()}
    assert got == {(u, v) for u in range(80) for v in range(80) if u != v and u // 4 == v // 4}
    assert counted["meeting-blocks"].count() < 0.25 * 40 * 41 / 2


@pytest.mark.parametrize("include_zero", [True, False])
def test_bounds_leave_out_pairs_of_blocks(spark, monkeypatch, include_zero):
    """Users and items of 20 themes: bounded scores equal all scores, and most pairs of blocks are not formed."""
    rnd, pairs, real = random.Random(4), [], content._score_pairs
    monkeypatch.setattr(content, "_score_pairs", lambda *a: (pairs.append(a[6]), real(*a))[1])
    vectors, seen = [], []
    for item in range(400):
        weights = [(f"t{item % 20}", 0.9), (f"t{item % 20}x{rnd.randrange(5)}", 0.4), ("every", 0.05 + 0.001 * (item % 7))]
        vectors += [(item, t, w) for t, w in weights]
    for user in range(120):
        seen += [(user, item, 1) for item in rnd.sample(range(user % 20, 400, 20), 6)]
    items = spark.createDataFrame([(i, f"title {i % 37}") for i in range(410)], "item_id long, title string")
    catalog = items.withColumnRenamed("item_id", "id")
    v, h = spark.createDataFrame(vectors, "item_id long, term string, weight double"), spark.createDataFrame(seen, "user_id long, item_id long, times long")
    every, some = ([tuple(r) for r in content.rank_content(
        content.block_scores(v, h, items, 5, include_zero, 6, 20, bounded_from), catalog, 5).select("user_id", "item_id", "score", "rank").collect()]
        for bounded_from in (10**9, 1))
    assert sorted(every) == sorted(some) and len(every) == 600
    assert pairs[0] == 20 * 21 and sum(pairs[1:]) < 0.4 * pairs[0]


def test_small_similarities_count_in_full(spark):
    cells = {(1, "a"): 4.0, (1, "b"): 2.0, (2, "c"): 5.0, (2, "d"): 1.0, (3, "c"): 2.0, (3, "e"): 4.0}
    near = spark.createDataFrame([(1, 2, 3.1e-8), (1, 3, -1.7e-8)], "user_id long, other_id long, sim double")
    got = {r.item_id: r.score for r in prediction.predict_pearson(_cells_frame(spark, cells), near, [1], bounds=None).collect()}
    both = 3 + (3.1e-8 * 2 + -1.7e-8 * -1) / (3.1e-8 + 1.7e-8)
    want = {"c": both, "d": 3 + 3.1e-8 * -2 / 3.1e-8, "e": 3 + -1.7e-8 * 1 / 1.7e-8}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_neighbors_of_all_users_need_a_limit(spark):
    with pytest.raises(ValueError):
        similarity.cosine_neighbors(_cells_frame(spark, {(1, "a"): 1.0}), None, None)


def test_one_user_with_everything(spark):
    cells = {(0, f"i{i}"): float(1 + i % 5) for i in range(3000)}
    cells.update({(u, f"i{(u * 37 + j) % 3000}"): float(1 + (u + j) % 5) for u in range(1, 40) for j in range(6)})
    df = _cells_frame(spark, cells)
    near = similarity.cosine_neighbors(df, None, 5)
    got = {(r.user_id, r.item_id) for r in prediction.predict_cosine(df, near).collect()}
    own = defaultdict(set)
    for u, i in cells:
        own[u].add(i)
    pairs = defaultdict(list)
    for r in near.collect():
        pairs[r.user_id].append(r.other_id)
    assert got == {(u, i) for u, others in pairs.items() for v in others for i in own[v] - own[u]}


def test_long_cell_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(prediction, "PACK_CELLS", 2)
    cells = _skewed_cells(5)
    df = spark.createDataFrame([(u, i, *v) for (u, i), v in cells.items()],
                               "user_id long, item_id string, rating double, seen double")
    near = similarity.pearson_neighbors(df, None, 6)
    split = {(r.user_id, r.item_id): r.score for r in prediction.predict_pearson(df, near).collect()}
    monkeypatch.setattr(prediction, "PACK_CELLS", 1024)
    assert split == {(r.user_id, r.item_id): r.score for r in prediction.predict_pearson(df, near).collect()}


def _texts(seed, n=80):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the", "and"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(d, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 25)))) for d in range(n)]


def _grams(text, low, high):
    toks = [w for w in text.split() if w not in ENGLISH_STOP_WORDS]
    return [" ".join(toks[i:i + n]) for n in range(low, high + 1) for i in range(len(toks) - n + 1)]


@pytest.mark.parametrize("size, low, high", [(5, 1, 3), (12, 1, 2), (29, 1, 3), (500, 1, 3), (10, 2, 3), (8, 1, 1), (25, 2, 2)])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_vocabulary(spark, monkeypatch, size, low, high, broadcast_rows):
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", broadcast_rows)
    texts = _texts(1)
    totals = Counter(g for _, t in texts for g in _grams(t, low, high))
    want = sorted(totals.items(), key=lambda p: (-p[1], p[0]))[:size]
    df = spark.createDataFrame(texts, "item_id long, text string")
    got = tfidf.vocabulary(df, size, low, high).collect()
    assert sorted((r.term, r.total) for r in got) == sorted(want)


def test_tfidf(spark):
    texts = _texts(2)
    df = spark.createDataFrame(texts, "item_id long, text string")
    totals = Counter(g for _, t in texts for g in _grams(t, 1, 3))
    vocab = {t for t, _ in sorted(totals.items(), key=lambda p: (-p[1], p[0]))[:20]}
    tf = {d: Counter(g for g in _grams(t, 1, 3) if g in vocab) for d, t in texts}
    dfs = Counter(t for c in tf.values() for t in c)
    want = {}
    for d, c in tf.items():
        w = {t: n * (math.log((1 + len(texts)) / (1 + dfs[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(d, t): x / norm for t, x in w.items()})
    got = {(r.item_id, r.term): r.weight for r in tfidf.tfidf_vectors(df, 20).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)
    top = tfidf.top_terms(tfidf.tfidf_vectors(df, 20), 2).collect()
    assert Counter(r.item_id for r in top) == {d: min(2, len(c)) for d, c in tf.items() if c}


def test_profiles_of_an_item_that_everyone_has(spark, monkeypatch):
    """A hot item's vector travels once to each group of blocks, however many raters it has."""
    monkeypatch.setattr(content, "BLOCK_USERS", 10)
    monkeypatch.setattr(content, "GROUP_BLOCKS", 2)
    rnd = random.Random(5)
    vectors = {i: {f"t{rnd.randrange(9)}": rnd.randint(1, 999) / 1000 for _ in range(4)} for i in range(12)}
    seen = {(u, 0): rnd.randint(1, 3) for u in range(300)}
    seen |= {(u, rnd.randrange(1, 15)): rnd.randint(1, 3) for u in range(300) for _ in range(3)}
    expected = {}
    for u in range(300):
        mine = {i: n for (v, i), n in seen.items() if v == u}
        total = defaultdict(float)
        for i, n in mine.items():
            for term, w in vectors.get(i, {}).items():
                total[term] += n * w
        expected |= {(u, t): round(w / sum(mine.values()), 7) for t, w in total.items()}
    cells = spark.createDataFrame([(*k, n) for k, n in seen.items()], "user_id long, item_id long, times long")
    rows = spark.createDataFrame(
        [(i, t, w) for i, v in vectors.items() for t, w in v.items()], "item_id long, term string, weight double")
    got = content.content_profile(rows, cells)
    assert {(r.user_id, r.term): round(r.weight, 7) for r in got.collect()} == expected
    one = content.content_profile(rows, cells, [7])
    assert {(r.user_id, r.term) for r in one.collect()} == {k for k in expected if k[0] == 7}


def test_dense_rows_are_expanded_without_the_users_of_their_bucket(spark, monkeypatch):
    """What reaches the expanding tasks holds a bucket's users once a task, however many rows are asked for."""
    monkeypatch.setattr(similarity, "ROWS_PER_TASK", 8)
    cells = _dense_case(spark, 9)
    lists, real = [], similarity.kernels.expand_rows
    listed = spark.sparkContext.accumulator(0)

    def counting(empty):
        inner = real(empty)

        def run(batches):
            def counted():
                for batch in batches:
                    listed.add(sum(len(x) for x in batch.column("others").drop_null()))
                    yield batch
            return inner(counted())

        lists.append(empty)
        return run

    monkeypatch.setattr(similarity.kernels, "expand_rows", counting)
    index = similarity.user_index(cells)
    everyone = [r.user_id for r in index.collect()]
    packed = similarity.packed_matrix(similarity.cosine_matrix(cells, index), index)
    got = similarity.dense_matrix(packed, index, index, 0.0).collect()
    assert {(r.user_id, r.other_id) for r in got} == {(u, o) for u in everyone for o in everyone} and len(got) == len(everyone) ** 2
    assert lists == [0.0] and 0 < listed.value < len(everyone) ** 2 / 4


@pytest.mark.parametrize("job", [similarity.pearson_neighbors, similarity.cosine_neighbors])
@pytest.mark.parametrize("raters, chunk", [(1024, 1 << 20), (7, 50)])
def test_gathered_neighbors_equal_those_of_listed_users(spark, monkeypatch, job, raters, chunk):
    """Lists of whole items, of cut ones, and sums that are folded often; the grid of pairs of blocks is not formed."""
    monkeypatch.setattr(similarity, "LIST_RATERS", raters)
    monkeypatch.setattr(similarity, "GATHER_FROM", 2)
    monkeypatch.setattr(similarity, "_gathered_blocks", lambda base, n_blocks: n_blocks)
    monkeypatch.setattr(similarity.kernels, "_CHUNK", chunk)
    monkeypatch.setattr(similarity, "block_pairs", None)
    df = _dense_case(spark, 3)
    want = {tuple(r) for r in job(df, list(range(60)), 5).collect()}
    assert {tuple(r) for r in job(df, None, 5, 9).collect()} == want


def test_items_of_few_raters_are_gathered(spark, monkeypatch):
    """Fewer rows a list than pairs of blocks; a table whose items everyone has stays with pairs of blocks."""
    monkeypatch.setattr(similarity, "GATHERED_PAIRS", 1000)
    sparse = _cells_frame(spark, {(u, f"{u % 37}-{(u * 7 + i) % 41}"): 3.0 for u in range(600) for i in range(4)})
    dense = _cells_frame(spark, {(u, f"i{i}"): 3.0 for u in range(150) for i in range(4)})
    base = lambda df: similarity._comparable(df, "pearson")
    assert similarity._gathered_blocks(base(sparse), 100) == 100
    assert similarity._gathered_blocks(base(dense), 4) is None


def _exchanged(df):
    """What the plan's exchanges of rows deal out by, as its text has them."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_ngrams_are_counted_where_they_are_made(spark, tmp_path, monkeypatch):
    """Texts move once, in whatever number of files they are; an item of very many texts is spread by its n-grams."""
    texts = [*_texts(3), *((7, t) for _, t in _texts(4, 9))]
    spark.createDataFrame(texts, "item_id long, text string").repartition(9).write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    want = Counter((d, g) for d, t in texts for g in _grams(t, 1, 3))
    counts = tfidf.ngram_counts(df)
    assert not any("term" in line for line in _exchanged(counts))
    assert {(r.item_id, r.term): r.tf for r in counts.collect()} == want
    monkeypatch.setattr(tfidf, "TEXTS_PER_TASK", 8)
    spread = tfidf.ngram_counts(df)
    assert any("term" in line for line in _exchanged(spread))
    assert {(r.item_id, r.term): r.tf for r in spread.collect()} == want


def test_profile_sums_are_not_shuffled(spark):
    vectors = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "b", 1.0)], "item_id long, term string, weight double")
    seen = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 2, 1)], "user_id long, item_id long, times long")
    got = content.content_profile(vectors, seen)
    keys = [line.split("hashpartitioning(")[1].split(")")[0] for line in _exchanged(got)]
    assert not any("user_id" in k and ("term" in k or "code" in k) for k in keys)
    assert {(r.user_id, r.term): r.weight for r in got.collect()} == {(1, "a"): 0.125, (1, "b"): 0.8125, (2, "b"): 1.0}


@pytest.mark.parametrize("predict", [prediction.predict_pearson, prediction.predict_cosine])
def test_best_predictions_are_ranked_where_they_are_added_up(spark, monkeypatch, predict):
    """Cells to every block or to some, in one part or more, as numbers or doubles: the same rows, and no sums are shuffled."""
    df = _dense_case(spark, 5)
    near = similarity.pearson_neighbors(df, None, 6).localCheckpoint()
    every = [tuple(r) for r in predict(df, near).select("user_id", "item_id", "score", "support", "rank").collect()]
    order = sorted(every, key=lambda r: (r[0], -r[2], r[1]))
    nth = [i - next(j for j, r in enumerate(order) if r[0] == row[0]) + 1 for i, row in enumerate(order)]
    assert [r[4] for r in order] == nth and max(nth) > 4
    want = {r for r in every if r[4] <= 4}
    forms, real = [], prediction.kernels.predictions
    monkeypatch.setattr(prediction.kernels, "predictions", lambda *a: forms.append(a[1] is None) or real(*a))
    monkeypatch.setattr(prediction.kernels, "_MET", 40)
    for least, held, kinds in ((12, 1 << 24, 1 << 15), (1, 1 << 24, 1 << 15), (1, 100, 1 << 15), (1, 100, 0), (12, 20, 0)):
        monkeypatch.setattr(prediction, "LEAST_BLOCKS", least)
        monkeypatch.setattr(prediction, "HELD_CELLS", held)
        monkeypatch.setattr(prediction, "KINDS", kinds)
        best = predict(df, near, k=4)
        assert {tuple(r) for r in best.select("user_id", "item_id", "score", "support", "rank").collect()} == want
        assert "hashpartitioning(user_id" not in best._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        assert sorted(map(tuple, prediction.rank_items(best, 2).collect())) == sorted(r for r in want if r[4] <= 2)
    assert forms == [False] * 3 + [True] * 2


@pytest.mark.parametrize("job", [similarity.pearson_neighbors, similarity.cosine_neighbors])
def test_gathered_raters_travel_as_two_numbers(spark, monkeypatch, job):
    """A rater's number, and one for its value and norm where those are few; no NULL lists. The rows are those of doubles."""
    monkeypatch.setattr(similarity, "GATHER_FROM", 2)
    monkeypatch.setattr(similarity, "_gathered_blocks", lambda base, n_blocks: n_blocks)
    types, real, nulls = [], similarity.kernels.gathered_similarity, spark.sparkContext.accumulator(0)

    def looking(*args):
        inner = real(*args)

        def run(batches):
            def counted():
                for batch in batches:
                    nulls.add(sum(batch.column(c).null_count for c in ("ids", "code", "val", "norm")))
                    yield batch
            return inner(counted())

        types.append(args[4])
        return run

    monkeypatch.setattr(similarity.kernels, "gathered_similarity", looking)
    df = _dense_case(spark, 3)
    few = {tuple(r) for r in job(df, None, 5, 9).collect()}
    monkeypatch.setattr(similarity, "KINDS", 0)
    assert few == {tuple(r) for r in job(df, None, 5, 9).collect()} and len(few) > 100
    assert types[0] and types[1] is None and nulls.value == 0


@pytest.mark.parametrize("matrix", [similarity.cosine_matrix, similarity.pearson_matrix])
def test_bitmaps_of_a_row_are_formed_once(spark, matrix):
    """Pairs are dealt out by row and bucket before any bitmap is formed, so that no task sends one of its own; rows are the same."""
    cells = _dense_case(spark, 3)
    index, asked = similarity.user_index(cells), list(range(20))
    packed = similarity.packed_matrix(matrix(cells, asked), index)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_bitmap_construct_agg") < plan.index("Exchange hashpartitioning(user_id")
    assert "bitmap_construct_agg" not in plan[plan.index("Exchange hashpartitioning(user_id"):]
    place = {r.user_id: r.pos for r in index.collect()}
    want = defaultdict(set)
    for r in matrix(cells, asked).collect():
        want[r.user_id].add((place[r.other_id] - 1, r.sim))
    for r in packed.collect():
        met = {i for i in range(8 * len(r.met)) if r.met[i // 8] >> i % 8 & 1}
        assert met == {p for p, _ in want[r.user_id]}
        assert dict(zip(r.pos, r.sim)) == {p: s for p, s in want[r.user_id] if s is not None}


def test_lists_to_a_block_travel_in_one_row(monkeypatch):
    """Many items' raters in a row, in few bytes each; the lists are those of the items."""
    rnd, n_blocks, kernels = random.Random(4), 5, similarity.kernels
    lists = [[(c, rnd.randrange(300)) for c in sorted(rnd.sample(range(70_000), rnd.randint(1, 9)))] for _ in range(400)]
    for kind in (pa.int16(), pa.float64()):
        kinds = kind == pa.int16()
        mixed = [rnd.sample(x, len(x)) for x in lists]
        rows = pa.RecordBatch.from_arrays(
            [pa.array([[c for c, _ in x] for x in mixed], pa.list_(pa.int32())), pa.array([[v for _, v in x] for x in mixed], pa.list_(kind)),
             pa.array([[] if kinds else [0.5 * v for _, v in x] for x in mixed], pa.list_(pa.float64()))], names=["code", "val", "norm"])
        for chunk in (1 << 20, 16):
            monkeypatch.setattr(kernels, "_CHUNK", chunk)
            got, n_rows, n_bytes, n_codes = Counter(), 0, 0, 0
            for out in kernels.packed_lists(n_blocks, 3, kinds)([rows.slice(0, 300), rows.slice(300)]):
                n_rows += out.num_rows
                n_bytes += sum(map(len, out.column("packed").to_pylist()))
                length, code, found = kernels._unpacked(out, 3)
                vals = found.tolist() if kinds else out.column("val").flatten().to_pylist()
                assert out.column("norm").flatten().to_pylist() == ([] if kinds else [0.5 * v for v in vals])
                n_codes += len(code)
                block = [b for b, s in zip(out.column("block").to_pylist(), out.column("sizes").to_pylist()) for _ in s]
                for b, e, n in zip(block, itertools.accumulate(length.tolist()), length.tolist()):
                    got[b, tuple(zip(code[e - n:e].tolist(), vals[e - n:e]))] += 1
            assert got == Counter((b, tuple(x)) for x in lists for b in {c % n_blocks for c, _ in x})
            assert chunk == 16 or (n_rows == 2 * n_blocks and n_bytes < 4.5 * n_codes)


def test_packed_neighbors(spark):
    rows = pa.RecordBatch.from_pydict({"block": pa.array([2, 0, 2, 0, 2], pa.int32()), "user_id": ["b", "c", "a", "c", "b"],
                                       "other_id": ["x", "y", "z", "w", "v"], "sim": [0.1, 0.2, 0.3, 0.4, 0.5]})
    out = pa.Table.from_batches(prediction.kernels.packed_neighbors()([rows.slice(0, 0), rows])).to_pylist()
    assert [r["block"] for r in out] == [0, 2]
    pairs = [set(zip(r["others"][: len(r["means"])], r["others"][len(r["means"]):], r["means"])) for r in out]
    assert pairs == [{("c", "y", 0.2), ("c", "w", 0.4)}, {("b", "x", 0.1), ("a", "z", 0.3), ("b", "v", 0.5)}]
