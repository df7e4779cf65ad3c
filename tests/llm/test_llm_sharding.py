"""Shards by histogram sort against the order and the sums worked out in plain Python."""

import zlib
from collections import Counter

import pytest

from tastemesh.llm import sharding as S
from tastemesh.llm.queries import op11_sharding

SCHEMA = "doc_id long, text string, size string, shard int, low double, part string, interval int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 9, 0.5, "p", 3) for i, t in rows], SCHEMA)


def check(rows, got, count, tolerance):
    """Same rows, gapless slots, and bytes as near to equal as the largest row and the tolerance allow."""
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    want = Counter((i, s, zlib.crc32((t or "").encode())) for (i, t), s in zip(rows, sizes, strict=True))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    share = sum(sizes) / count
    for shard in range(count):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    # Splitters, not shards, are held to the tolerance: each is the nearest edge, or within it.
    below = 0
    for shard in range(count - 1):
        below += sum(r["size"] for r in got if r.shard == shard)
        assert abs(below - (shard + 1) * share) <= max(tolerance * share, max(sizes) / 2)
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)


CASES = {
    "plain": [(i, "word " * (i % 17)) for i in range(400)],
    "hot text": [(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 5)) for i in range(600)],
    "hot rows": [(7 if i % 3 else i, "again" if i % 3 else f"other {i}") for i in range(500)],
    "nulls": [(None, None)] * 50 + [(None, "x")] * 20 + [(i, None) for i in range(40)] + [(1, ""), (2, "é" * 9)],
    "one long": [(i, "a b") for i in range(30)] + [(30, "long " * 20000)],
    "fewer than shards": [(1, "a"), (2, "b"), (3, "c")],
    "one": [(1, "only")],
}


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("count", [1, 5])
def test_shards(spark, name, count):
    rows = CASES[name]
    got = S.shards(frame(spark, rows), count, rows_per_piece=4).collect()
    check(rows, got, count, S.TOLERANCE)


def test_equal_texts_stay_together_where_shares_allow(spark):
    rows = [(i, f"text {i % 100} " * 3) for i in range(1000)]
    got = S.shards(frame(spark, rows), 4, tolerance=0.1).collect()
    check(rows, got, 4, 0.1)
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_no_rows(spark):
    got = S.shards(frame(spark, []))
    assert got.collect() == []
    assert got.columns == ["doc_id", *S.RESULTS]


def test_slots_follow_one_order_over_pieces(spark):
    rows = CASES["hot text"]
    one, many = (
        {r.doc_id: (r.shard, r.slot) for r in S.shards(frame(spark, rows), 3, rows_per_piece=n).collect()} for n in (1 << 20, 2))
    assert one == many


def test_written_shards(spark, tmp_path):
    rows = CASES["nulls"]
    S.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    for shard in range(4):
        own = sorted(r.slot for r in back if r.shard == shard)
        assert own == list(range(len(own)))


def test_names_of_results_are_refused(spark):
    with pytest.raises(ValueError, match="shard"):
        S.shards(frame(spark, CASES["one"]), carry=("doc_id", "shard"))


def test_query(spark):
    got = op11_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(docs, got, 8, S.TOLERANCE)
