"""Cheapest repair of the turn structure of conversations, with block tables in the manner of the Four Russians.

A repaired conversation has the role initials ``(s?(ua)+)?``: that is an automaton of four states (nothing yet, after the
system turn, after a user, after an assistant). Edits: keep a row (0), give it the role user or assistant (3), delete it
(4; the only choice for blank and duplicate rows), insert an empty turn (3); a truncated row that stays costs 3 more.
Rows are ``SYMBOLS`` symbols to the automaton. The cost of the best way from each state to the end is a vector; less its
least entry it is one of a few dozen. ``block_tables`` finds all of them and, for each and for every block of
``BLOCK`` symbols, the vector before the block and the cost added, so a conversation is worked off a block at a time by
lookup, from its end. Only the cheapest edits are then traced: a block's vectors are expanded again, from its end
backward, and letters are chosen forward, the least in ASCII of those that keep the least cost, so ties cannot mislead.

In Spark: a first pass needs no texts. Equal rows of a turn are counted before anything is shuffled, repeats of a role and
text are marked by a window, and each conversation streams by in reverse order. What is kept of it is the vector at
the end of every chunk of ``CHUNK`` rows. The second pass streams texts forward, each chunk preceded by its symbols
and vector, and gives edits and the hash of the result. Both passes hold one chunk of one conversation, however long it
is; a conversation has one result, its edits and its hash being sequences, so it is one stream.

Edge cases: null role and text become one space, so a null text is blank; rows of one turn come by role, then by the MD5
of the text (null turns first); equal rows of a turn stand side by side, all but the first duplicates, or all blank;
a null ``conv_id`` is a conversation like others; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemesh.llm.streams import streamed
from tastemesh.sources.staging import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK, CHUNK, MEMO = 4, 4096, 1 << 15
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
# What a row of each initial moves the automaton to, and what an edit that makes a user or assistant turn does.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = MOVES["u"] | MOVES["a"]
INITIALS = ("s", "u", "a", "")
GONE = 8  # blank or duplicate; other symbols are 2 * initial + truncated
SYMBOLS = 9
_SPACE = " \t\n\x0b\x0c\r"


def _inserted(costs: list[int]) -> list[int]:
    """Costs from each state if turns may be inserted first; the end is reached after two of them from any state."""
    best = list(costs)
    for _ in range(2):
        best = [min(best[s], INSERT + best[NEXT[s]]) for s in range(4)]
    return best


def end_costs() -> list[int]:
    """Costs after the last row."""
    return _inserted([0 if s in GOALS else 10**6 for s in range(4)])


def before(symbol: int, costs: list[int]) -> list[int]:
    """Costs before a row, from those after it."""
    return _inserted([min(c for c, _, _ in ways(symbol, s, costs)) for s in range(4)])


def ways(symbol: int, state: int, costs: list[int]) -> list[tuple[int, str, int]]:
    """Cost to the end, letter and next state of every edit of a row, in the order of the letters."""
    found = [(DELETE + costs[state], "D", state)]
    if symbol != GONE:
        more, kept = TRUNCATED * (symbol % 2), MOVES.get(INITIALS[symbol // 2], {}).get(state)
        if kept is not None:
            found.append((KEEP + more + costs[kept], "K", kept))
        found.append((REROLE + more + costs[NEXT[state]], "R", NEXT[state]))
    return found


@dataclass(frozen=True, eq=False)
class Tables:
    """``vectors``: all normalised cost vectors. By vector after and block: ``into``, the vector before; ``cost``, what is added."""

    vectors: tuple[tuple[int, ...], ...]
    last: int  # the vector after the last row
    last_cost: int
    single: np.ndarray  # the same for blocks of one symbol
    single_cost: np.ndarray
    into: np.ndarray
    cost: np.ndarray


@cache
def block_tables(block: int = BLOCK) -> Tables:
    """Tables for every block of ``block`` symbols; a block's number has its first symbol as the highest digit."""

    def normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
        least = min(costs)
        return tuple(c - least for c in costs), least

    last, last_cost = normal(end_costs())
    vectors, steps, at = {last: 0}, [], 0
    queue = [last]
    while at < len(queue):
        for symbol in range(SYMBOLS):
            vector, added = normal(before(symbol, list(queue[at])))
            if vector not in vectors:
                vectors[vector] = len(queue)
                queue.append(vector)
            steps.append((vectors[vector], added))
        at += 1
    single, single_cost = (np.array(x, np.int32).reshape(len(queue), SYMBOLS) for x in zip(*steps, strict=True))
    into, cost = np.arange(len(queue), dtype=np.int32)[:, None], np.zeros((len(queue), 1), np.int32)
    for _ in range(block):  # one more symbol in front
        cost = (cost[:, None, :] + single_cost[into].transpose(0, 2, 1)).reshape(len(queue), -1)
        into = single[into].transpose(0, 2, 1).reshape(len(queue), -1)
    return Tables(tuple(queue), 0, last_cost, single, single_cost, into, cost)


def backward(symbols: bytes, vector: int, tables: Tables) -> tuple[int, int]:
    """The vector before a run of symbols and the cost added, from the vector after it; by blocks, then what is left in front."""
    size = BLOCK
    lead = len(symbols) % size
    codes = np.frombuffer(symbols, np.uint8)[lead:].reshape(-1, size).astype(np.int64) @ (SYMBOLS ** np.arange(size - 1, -1, -1))
    into, cost, total = tables.into, tables.cost, 0
    for code in codes[::-1].tolist():
        total += int(cost[vector, code])
        vector = int(into[vector, code])
    for symbol in symbols[:lead][::-1]:
        total += int(tables.single_cost[vector, symbol])
        vector = int(tables.single[vector, symbol])
    return vector, total


def trace(symbols: bytes, vector: int, state: int, tables: Tables, last: bool, known: dict) -> tuple[list[str], int]:
    """The letters of each row of a run, with those inserted before it, and the state after; after ``last`` rows one more
    entry, of insertions at the end. ``vector`` belongs to the end of the run; ``known`` keeps the letters of blocks."""
    bounds, lead = [vector], len(symbols) % BLOCK
    cuts = [0, *range(lead, len(symbols) + 1, BLOCK)] if lead else [*range(0, len(symbols) + 1, BLOCK)]
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        bounds.append(backward(symbols[a:b], bounds[-1], tables)[0])
    letters: list[str] = []
    for a, b, after in zip(cuts, cuts[1:], bounds[-2::-1], strict=False):
        key = symbols[a:b], after, state
        if key not in known:
            if len(known) >= MEMO:
                known.clear()
            known[key] = _block_letters(*key, tables.vectors)
        made, state = known[key]
        letters += made
    if last:
        tail = ""
        while state not in GOALS:
            tail, state = tail + "I", NEXT[state]
        letters.append(tail)
    return letters, state


def _block_letters(symbols: bytes, vector: int, state: int, vectors: tuple[tuple[int, ...], ...]) -> tuple[list[str], int]:
    """Expand one block backward and choose its letters forward."""
    costs = [list(vectors[vector])]
    for symbol in reversed(symbols):
        costs.append(before(symbol, costs[-1]))
    costs.reverse()
    letters = []
    for symbol, here, after in zip(symbols, costs, costs[1:], strict=False):
        made, due = "", here[state]
        while True:
            best = [(letter, to) for cost, letter, to in ways(symbol, state, after) if cost == due]
            if INSERT + here[NEXT[state]] == due:
                best.append(("I", NEXT[state]))
            letter, state = min(best)
            made += letter
            if letter != "I":
                break
            due -= INSERT
        letters.append(made)
    return letters, state


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after the damage that each row's checksum names."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("times"))


def repair(rows: DataFrame) -> DataFrame:
    """Per ``conv_id`` of rows (``conv_id``, ``turn``, ``role``, ``text`` without nulls in the last two, and optionally
    ``times``, how often the row stands there): ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256``. Conversations all of whose rows stand there no times have no result."""
    tables = rows.sparkSession.sparkContext.broadcast(tuple(vars(block_tables()).values()))  # under 1 MB
    keyed = rows.select(
        "conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"),
        (F.col("times") if "times" in rows.columns else F.lit(1)).cast("long").alias("times")).where("times > 0")
    chunks = stage(_chunks(keyed, tables), "chunks")
    counts = chunks.where("symbols IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    done = _repaired(keyed, chunks.where("symbols IS NOT NULL"), tables)
    return counts.join(done, counts["conv_id"].eqNullSafe(done["conv_id"])).drop(done["conv_id"])


_ORDER = ("turn", "role", "digest")


def _symbol() -> Column:
    """The symbol of a row by itself, ``GONE`` where it is blank."""
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = F.rtrim("text", F.lit(_SPACE))
    return F.when(bare == "", GONE).otherwise(2 * number + F.when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1))


def _chunks(keyed: DataFrame, tables) -> DataFrame:
    """By conversation, a row of counts and, for each chunk, its first row's place in the order, symbols and end vector."""
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    narrow = (
        keyed.select("conv_id", *_ORDER, "times", _symbol().cast("byte").alias("symbol"))
        .groupBy("conv_id", *_ORDER, "symbol").agg(F.sum("times").alias("times"))
        .repartition("conv_id")
        .select("conv_id", *_ORDER, "times", "symbol", (F.row_number().over(seen) > 1).alias("again"))
        .sortWithinPartitions("conv_id", *(F.col(c).desc_nulls_last() for c in _ORDER)))
    columns = ", ".join(
        ("conv_id long", "turn long", "role string", "digest binary", "symbols binary", "vector int", "last boolean", *(f"{c} long" for c in _COUNTS)))

    return streamed(narrow, lambda conv_id: _Backward(conv_id, Tables(*tables.value)), columns)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Backward:
    """One conversation, its last row first."""

    def __init__(self, conv_id, tables: Tables):
        self.conv_id, self.tables = conv_id, tables
        self.vector, self.cost = tables.last, tables.last_cost
        self.symbols, self.end, self.last = bytearray(), tables.last, True  # reversed symbols of the open chunk
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.high = self.low = self.initial = self.first = None

    def row(self, turn, role, digest, times, symbol, again) -> None:
        if len(self.symbols) >= CHUNK:
            self._close()
        if turn is not None and turn != self.low:
            self.turns, self.low = self.turns + 1, turn
            self.high = turn if self.high is None else self.high
        initial = role[:1]
        if self.initial is not None:
            self.illegal += initial + self.initial not in ("su", "ua", "au")
        self.illegal += times - 1
        self.initial = initial
        if symbol == GONE:
            self.blank += times
        else:
            fresh = 0 if again else 1
            self.duplicate += times - fresh
            self.truncated += fresh * (symbol % 2)
        own = GONE if again else symbol
        self.symbols += bytes([GONE]) * (times - 1) + bytes([own])
        self.first = (turn, role, digest)

    def _close(self) -> None:
        run = bytes(reversed(self.symbols))
        self.vector, added = backward(run, self.end, self.tables)
        self.out.append((self.conv_id, *self.first, run, self.end, self.last, *[None] * len(_COUNTS)))
        self.cost += added
        self.symbols, self.end, self.last = bytearray(), self.vector, False

    def finish(self) -> None:
        self._close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost = self.cost + self.tables.vectors[self.vector][START]
        self.out.append((self.conv_id, None, None, None, None, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost))


def _repaired(keyed: DataFrame, chunks: DataFrame, tables) -> DataFrame:
    """``conv_id``, ``audit``, ``repaired_sha256``: texts and chunks in one stream a conversation."""
    texts = keyed.withColumns({"symbols": F.lit(None).cast("binary"), "vector": F.lit(None).cast("int"), "last": F.lit(None).cast("boolean")})
    heads = chunks.select("conv_id", *_ORDER, F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"), "symbols", "vector", "last")
    both = texts.select(heads.columns).unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER, "times")
    known: dict = {}  # one a task, as it travels with the job
    return streamed(both, lambda conv_id: _Forward(conv_id, Tables(*tables.value), known), "conv_id long, audit string, repaired_sha256 string")


class _Forward:
    """One conversation in order; each chunk's symbols come before its rows."""

    def __init__(self, conv_id, tables: Tables, known: dict):
        self.conv_id, self.tables, self.known = conv_id, tables, known
        self.state, self.letters, self.at, self.audit = START, [], 0, []
        self.hash, self.lines, self.role = hashlib.sha256(), 0, START

    def row(self, turn, role, digest, text, times, symbols, vector, last) -> None:
        if symbols is not None:
            self.letters, self.state = trace(symbols, vector, self.state, self.tables, last, self.known)
            self.audit.append("".join(self.letters))
            self.at = 0
            return
        for letters in self.letters[self.at : self.at + times]:
            for letter in letters:
                if letter == "K":
                    self._line(role, text)
                    self.role = MOVES[role[:1]][self.role]
                elif letter != "D":
                    self._made(text if letter == "R" else "")
        self.at += times

    def _made(self, text: str) -> None:
        self.role = NEXT[self.role]
        self._line("user" if self.role == USER else "assistant", text)

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def finish(self) -> None:
        for _ in self.letters[-1]:
            self._made("")
        self.out.append((self.conv_id, "".join(self.audit), self.hash.hexdigest()))
