"""Decontamination, substring removal and the Jaccard join against brute force."""

import pytest
from llm_brute import contamination, corpus, frame, jaccard, near, substring, words
from pyspark.sql import functions as F

from tastemesh.llm import decontaminate as D
from tastemesh.llm import jaccard_join as J
from tastemesh.llm import substrings as S
from tastemesh.llm.components import components


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def items(docs):
    words = docs[134].split()
    return {
        0: docs[3], 1: " ".join(words[100:130]), 2: " ".join(words[400:410]).upper(), 3: "a b c", 4: None, 5: " ,. ", 10: docs[110][:200],
        11: " ".join(reversed(words[500:520])), 12: "x x x", 13: " ".join(words[100:109]) + " zz",
    }


def _items(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(None, "a b", 1)], "item_id long, text string, terms int")


@pytest.mark.parametrize("block", [200_000, 9])
def test_contamination(spark, docs, items, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    rows = D.contamination(frame(spark, docs), _items(spark, items)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in rows}
    want = contamination(docs, items)
    assert got == want and len(rows) == len(docs)
    assert all(r.contaminated == bool(want[r.doc_id][1]) and r.n_items == len(want[r.doc_id][2]) for r in rows)


def test_contamination_of_edges(spark, docs, items):
    twice = frame(spark, {5: docs[5]}).unionByName(frame(spark, {5: docs[5], 6: None}))
    unnamed = twice.withColumn("doc_id", F.lit(None).cast("long"))
    assert D.contamination(twice.unionByName(unnamed), _items(spark, items)).count() == 6
    assert D.contamination(frame(spark, docs).where("false"), _items(spark, items)).count() == 0
    none = D.contamination(twice, _items(spark, items).where("false")).collect()
    assert [r.contaminated for r in none] == [False] * 3


def test_proximity(spark):
    docs = {1: "a " + "q " * 3 + "b c", 2: "a " + "q " * 30 + "b c", 3: "c b a", 4: "a b"}
    index = D.build_index(frame(spark, docs)).withColumn("seg", F.monotonically_increasing_id())
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    near = {r.doc_id: list(r["items"]) for r in D.proximity_matches(index, items, 10, 8).collect()}
    assert near == {1: [1], 2: [], 3: [1], 4: []}
    assert all(not r["items"] for r in D.phrase_matches(index, items).collect())


@pytest.mark.parametrize("block, terms", [(200_000, 2_000_000), (9, 7)])
def test_proximity_of_shuffled_windows(spark, docs, items, block, terms, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(D, "BLOCK_TERMS", terms)
    some = items | {20: " ".join(sorted(words(docs[134])[200:210])), 21: " ".join(words(docs[134])[300:320:2]), 22: "neverseen " + docs[3]}
    want = near(docs, some)
    rows = D.contamination(frame(spark, docs), _items(spark, some), span=20).collect()
    assert {r.doc_id: list(r["near"]) for r in rows} == want and len(rows) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in rows} == contamination(docs, some)
    assert {20, 21} <= set(want[134]) and any(set(r["near"]) > set(r["items"]) for r in rows)
    none = D.contamination(frame(spark, docs).where("false"), _items(spark, some), span=20)
    assert none.isEmpty() and "near" in none.columns


def test_substrings(spark, docs):
    rows = S.remove_repeats(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == substring(docs) and len(rows) == len(docs)


@pytest.mark.parametrize("size, run", [(3, 50), (12, 1 << 20)])
def test_substrings_of_other_sizes(spark, docs, size, run, monkeypatch):
    monkeypatch.setattr(S, "_RUN", run)
    some = {i: t for i, t in docs.items() if i % 3 == 0 or i > 124}
    rows = S.remove_repeats(frame(spark, some), size).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == substring(some, size)


def test_substrings_of_edges(spark, docs):
    text = docs[134]
    same = frame(spark, {5: text}).unionByName(frame(spark, {5: text}))
    assert [r.n_removed for r in S.remove_repeats(same).collect()] == [0, 0]
    unnamed = same.withColumn("doc_id", F.lit(None).cast("long")).unionByName(frame(spark, {9: text}))
    assert [r.n_removed for r in S.remove_repeats(unnamed).collect()] == [0, 0, 0]
    assert S.remove_repeats(same.where("false")).count() == 0


@pytest.mark.parametrize("frequent, hub_rounds, small", [((1000, 50_000), 6, 64), ((0, 3), 1, 8), ((3, 10**9), 2, 8), ((-10**9, -10**9), 0, 4), ((-10**9, 2), 3, 16)])
def test_jaccard_classes(spark, docs, frequent, hub_rounds, small, monkeypatch):
    monkeypatch.setattr(J, "SMALL", small)
    rows = J.classes(frame(spark, docs), frequent=frequent, hub_rounds=hub_rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == jaccard(docs) and len(rows) == len(docs)


def test_pairs_grow_with_a_group_not_its_square(spark, monkeypatch):
    """Near copies of one text: twice as many make about twice the pairs that are verified."""
    counted, real = [], J.stage

    def counting(df, label):
        out = real(df, label)
        if label == "pairs":
            counted[-1] += out.count()
        return out

    monkeypatch.setattr(J, "stage", counting)
    base = [f"w{i}" for i in range(200)]
    for n in (150, 300):
        texts = {i: " ".join([*base[:i % 190], f"own{i}", *base[i % 190 + 1:]]) for i in range(n)}
        counted.append(0)
        rows = J.classes(frame(spark, texts)).collect()
        assert {r.component_id for r in rows} == {0}
    assert 0 < counted[1] <= 3 * counted[0] and counted[1] < 20 * 300


def test_jaccard_of_edges(spark, docs):
    some = frame(spark, {1: docs[1], 2: None, 3: docs[1]}).unionByName(frame(spark, {3: docs[1]}))
    unnamed = frame(spark, {8: docs[1]}).withColumn("doc_id", F.lit(None).cast("long"))
    rows = J.classes(some.unionByName(unnamed)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows)
    assert got == [(False, 1, 1), (False, 2, 2), (False, 3, 1), (False, 3, 1), (True, 0, None)]
    assert J.classes(some.where("false")).count() == 0
    assert [r.component_id for r in J.classes(frame(spark, {4: ""})).collect()] == [4]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(300, 301), (302, 301), (5, 160), (400, 400)] + [(7, i) for i in range(500, 540)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in [5, *range(100, 161)]}, **{i: 300 for i in (300, 301, 302)}, **{i: 7 for i in [7, *range(500, 540)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
