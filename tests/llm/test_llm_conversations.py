"""Conversation repair and prefix trie: automaton against brute force, edge cases against SQL."""

import random

import duckdb
import pandas as pd
import pytest

from checks.compare import difference
from tastemesh.llm import repair as R
from tastemesh.llm import trie as T
from tastemesh.llm.oracle import ORACLE
from tastemesh.llm.queries import op12_conversation_repair, op13_prefix_trie


def cheapest(symbols):
    """Least cost and, of its edits, the least letters, by trying every edit of every row from every state."""
    best = {R.START: (0, "")}

    def insert():
        for _ in range(4):
            for state, (cost, letters) in list(best.items()):
                way = (cost + R.INSERT, letters + "I")
                best[R.NEXT[state]] = min(best.get(R.NEXT[state], way), way)

    for symbol in symbols:
        insert()
        after = {}
        for state, (cost, letters) in best.items():
            ways = [(state, R.DELETE, "D")]
            if symbol != R.GONE:
                more, initial = R.TRUNCATED * (symbol % 2), R.INITIALS[symbol // 2]
                ways.append((R.NEXT[state], R.REROLE + more, "R"))
                if initial and state in R.MOVES[initial]:
                    ways.append((R.MOVES[initial][state], more, "K"))
            for to, add, letter in ways:
                way = (cost + add, letters + letter)
                after[to] = min(after.get(to, way), way)
        best = after
    insert()
    return min(best[s] for s in R.GOALS if s in best)


def test_blocks_give_the_cheapest_least_edits():
    tables, rng = R.block_tables(), random.Random(3)
    for _ in range(3000):
        symbols = bytes(rng.choice([0, 1, 2, 2, 2, 3, 4, 4, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(14)))
        cut = rng.randrange(len(symbols) + 1)
        middle, late = R.backward(symbols[cut:], tables.last, tables)
        vector, early = R.backward(symbols[:cut], middle, tables)
        cost = early + late + tables.last_cost + tables.vectors[vector][R.START]
        first, state = R.trace(symbols[:cut], middle, R.START, tables, False, {})
        second, _ = R.trace(symbols[cut:], tables.last, state, tables, True, {})
        assert (cost, "".join(first + second)) == cheapest(symbols)


def test_tables_agree_with_single_steps():
    tables = R.block_tables(2)
    for vector, costs in enumerate(tables.vectors):
        for a in range(R.SYMBOLS):
            for b in range(R.SYMBOLS):
                want = R.before(a, R.before(b, list(costs)))
                code = a * R.SYMBOLS + b
                got = [c + int(tables.cost[vector, code]) for c in tables.vectors[tables.into[vector, code]]]
                assert got == want


ROWS = [
    # conv_id, turn, role, text
    *[(1, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(9)],
    *[(2, t, "system" if t == 0 else "user", "The same words.") for t in range(7)],
    (3, None, "user", "no turn"), (3, None, "assistant", None), (3, 4, None, "No role."), (3, 4, "user", "Tie."), (3, 4, "user", "Another tie."),
    *[(4, 1, "user", "Thrice the same.")] * 3, (4, 2, "assistant", " \t\n"), (4, 9, "tool", "Unknown role?"), (4, 9, "", "."),
    (5, None, None, None), (None, 1, "user", "Nobody."), (None, 2, "assistant", "Nobody else"),
    *[(100, t, "ua"[t % 2] if t % 5 else "system", "Ça va ? " * (t % 3) + "!") for t in range(40)],
    *[(100 + k, t, "user" if t % 2 == 0 else "assistant", f"Part {t if t < k else 'x' * t}.") for k in range(1, 12) for t in range(k % 7 + 1)],
    *[(300 + k, t, "user" if t % 2 == 0 else "assistant", "Common start." if t < 4 else f"End {k % 3}.") for k in range(1, 30) for t in range(4 + k % 4)],
    (-207, 0, "user", "Below zero."), (-200, 0, "user", "Base below zero."), (-200, 1, "assistant", "More."),
    (2**62, 0, "user", "Far."), (2**62 + 1, 3, "user", "Far."), (500, 0, "user", "word " * 40000), (501, 0, "user", "word " * 40000 + "."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("conversations")
    pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).assign(
        n="1", owner=2, node=b"x", cost=None, symbols="s", h=7, pos=0).to_parquet(path / "conversations.parquet")
    empty = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}).to_parquet(
        empty / "conversations.parquet")
    return path, empty


def sql(name, path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet'")
    return con.execute(ORACLE[name]).df()


@pytest.mark.parametrize("query", [op12_conversation_repair, op13_prefix_trie])
def test_edge_cases_equal_sql(spark, folder, query):
    for path in folder:
        got = query(spark, str(path)).toPandas()
        assert difference(got, sql(query.__name__, path)) is None
    assert got.empty


def test_chunks_do_not_change_repairs(spark, folder, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 3)
    got = op12_conversation_repair(spark, str(folder[0])).toPandas()
    assert difference(got, sql("op12_conversation_repair", folder[0])) is None


@pytest.mark.parametrize("block", [1, 3, 50])
def test_block_length_does_not_change_the_trie(spark, folder, block, monkeypatch):
    monkeypatch.setattr(T, "PACK", 2)
    conversations = spark.read.parquet(f"{folder[0]}/conversations.parquet")
    got = T.trie(*T.rebuilt(T.numbered(conversations)), block=block).toPandas()
    assert difference(got, sql("op13_prefix_trie", folder[0])) is None


def test_repair_of_plain_rows(spark):
    rows = spark.createDataFrame([(7, 1, "assistant", "Hello."), (7, 2, "user", "Hi!"), (7, 3, "assistant", "cut off")], SCHEMA)
    (got,) = R.repair(rows).collect()
    assert (got.audit, got.cost, got.truncated, got.illegal) == ("IKKK", 6, 1, 0)


def test_digests_only_where_blocks_fork(spark):
    """Nodes inside a block that nothing forks from need none of the refined rows: 50 members of one path, one fork."""
    turns = [(c, p, bytes([p, c if p == 8 else 0]) * 8, 1) for c in range(50) for p in range(1, 13)]
    rows = spark.createDataFrame(turns, "conv_id long, pos long, digest binary, chars long")
    ids = spark.createDataFrame([(c, False) for c in range(50)], "conv_id long, turnless boolean")
    got = T.trie(rows, ids, block=4).toPandas()
    assert len(got) == 1 + 7 + 50 * 5
    assert got[got.depth == 7].iloc[0][["n_convs", "n_children", "n_leaves", "saved_tokens"]].tolist() == [50, 50, 50, 49]
    assert got[got.depth == 0].iloc[0]["saved_tokens"] == 49 * 7
