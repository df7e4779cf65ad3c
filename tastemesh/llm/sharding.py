"""Shards of near-equal bytes by histogram sort. DataFrame functions only.

Rows are ordered by a hash of their text, then a hash of ``doc_id``, then a row number, so the order is strict and equal
texts stand side by side. Splitters between shards are found without sorting: each round counts, over all partitions,
the exact bytes and rows below evenly spaced probes, and probes again only inside the cells that a splitter falls into,
between the smallest and largest key found there, until an edge lies within ``tolerance`` of a shard's share or the cell
is a single row. Edges between texts are met first, so a group of equal texts is cut only where it has to be: because no
edge of a text is near enough, as where one text holds a third of all bytes.

The same rounds place looser splitters that cut shards into pieces of about ``rows_per_piece`` rows. Exact counts below
each piece are known by then, so one exchange of the rows gives every row its shard and its place, and no task holds more
than a few pieces. Rounds look at staged keys (``tables`` below: cells that rows fall into, at most ``FIRST_CELLS`` a
piece in the first round and ``CELLS`` a piece after it; the pieces are at most ``MAX_PIECES`` a shard, and larger beyond).

Edge cases: a null text counts as an empty one; null ids and rows that are equal in all columns are ordinary rows, dealt
out one by one; a text larger than a share makes its shard as large as itself, and others empty if need be; no rows give
no rows. Columns that are not carried are not read; a carried column may not have the name of a result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tastemesh.sources.staging import stage

SHARDS, TOLERANCE = 8, 0.001
ROWS_PER_PIECE, LEAST_PIECES, MAX_PIECES = 1 << 16, 32, 4096
FIRST_CELLS, CELLS = 16, 64
PIECE_TOLERANCE = 0.25  # of a piece
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_KEYS = ("key_text", "key_id", "key_row")
_OUTCOME = "at_interval int, at_cell long, to_shard int, to_piece long, to_interval int, to_part int, to_low long, to_step long"


@dataclass
class _Interval:
    """A stretch of keys that splitters fall into: key number ``part`` is probed from ``low`` on in steps of ``step``."""

    number: int
    part: int
    low: int
    step: int
    below: int = 0  # bytes before it
    shard: int = 0  # splitters between shards before it
    piece: int = 0  # splitters before it
    targets: list[tuple[float, float, bool]] = field(default_factory=list)  # bytes, tolerance, whether between shards


def keyed(documents: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Carried columns, size, checksum and the three sort keys of each row."""
    if clash := {*carry} & {*RESULTS, *_KEYS}:
        raise ValueError(f"carried columns have names of results: {sorted(clash)}")
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        *carry, (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("key_text"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("key_id"),
        F.monotonically_increasing_id().alias("key_row"))


def shards(documents: DataFrame, count: int = SHARDS, carry: Sequence[str] = ("doc_id",), tolerance: float = TOLERANCE,
           rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Each row's carried columns, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``."""
    rows = stage(keyed(documents, carry), "keys")
    levels, starts = _splitters(rows, count, tolerance, rows_per_piece)
    if not levels:
        return rows.select(*carry, "size", "text_crc32", *_results(F.lit(0), F.lit(0))).limit(0)
    dealt = _enter(rows, levels[0][0])
    for _, outcome in levels[1:]:
        dealt = _meet(dealt, outcome, "left")
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*_KEYS))
    return dealt.join(F.broadcast(starts), ["shard", "piece"]).select(
        *carry, "size", "text_crc32", *_results(F.col("shard"), F.col("start") + within - 1))


def write_shards(documents: DataFrame, path: str, count: int = SHARDS, **settings) -> None:
    """Write all columns of ``documents`` into one folder a shard, with each row's ``slot``."""
    dealt = shards(documents, count, documents.columns, **settings)
    dealt.select(*documents.columns, "slot", "shard").write.partitionBy("shard").parquet(path)


def _results(shard, slot) -> list:
    return [F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard")]


def _enter(rows: DataFrame, first: _Interval) -> DataFrame:
    """All rows stand in the first interval, in no shard yet."""
    return rows.withColumns({
        "shard": F.lit(None).cast("int"), "piece": F.lit(None).cast("long"), "interval": F.lit(first.number),
        "part": F.lit(first.part), "low": F.lit(first.low), "step": F.lit(first.step)})


def _cell() -> F.Column:
    return F.expr("(CASE part WHEN 0 THEN key_text WHEN 1 THEN key_id ELSE key_row END - low) DIV step")


def _meet(rows: DataFrame, outcome: DataFrame, how: str) -> DataFrame:
    """Move rows on by one round: what stands in an interval gets its shard and piece, or enters the next interval."""
    moved = ("interval", "part", "low", "step")
    met = rows.join(F.broadcast(outcome), (F.col("interval") == F.col("at_interval")) & (_cell() == F.col("at_cell")), how)
    return met.select(
        *(c for c in rows.columns if c not in ("shard", "piece", *moved)),
        F.coalesce("shard", "to_shard").alias("shard"), F.coalesce("piece", "to_piece").alias("piece"),
        *(F.col(f"to_{c}").alias(c) for c in moved))


def _splitters(rows: DataFrame, count: int, tolerance: float, rows_per_piece: int):
    """The first interval, then a table of outcomes by cell for each round; and the first slot of each piece."""
    spans = [x for key in _KEYS for x in (F.min(key), F.max(key))]
    total, n, low, high = rows.agg(F.sum("size"), F.count("*"), *spans).first()[:4]
    if not n:
        return [], None
    spark = rows.sparkSession
    pieces = min(MAX_PIECES, max(LEAST_PIECES, -(-n // (count * rows_per_piece))))
    share = total / (count * pieces)
    targets = [
        (q * share, (tolerance * pieces if q % pieces == 0 else PIECE_TOLERANCE) * share, q % pieces == 0)
        for q in range(1, count * pieces)]
    first = _Interval(0, 0, low, _step(low, high, FIRST_CELLS * count * pieces), targets=targets)
    levels, opened, numbers, sizes = [(first, None)], [first], 1, Counter()
    here = _enter(rows, first)
    while opened:
        found = here.groupBy("interval", _cell().alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *(
            F.struct(F.min(k).alias("low"), F.max(k).alias("high")).alias(k) for k in _KEYS)).orderBy("interval", "cell").collect()
        by_interval: dict[int, list[Row]] = {}
        for row in found:
            by_interval.setdefault(row.interval, []).append(row)
        outcomes, entered = [], []
        for interval in opened:
            for row, shard, piece, inner in _outcomes(interval, by_interval[interval.number]):
                if inner:
                    inner.number, numbers = numbers, numbers + 1
                    entered.append(inner)
                    outcomes.append((interval.number, row.cell, None, None, inner.number, inner.part, inner.low, inner.step))
                else:
                    sizes[shard, piece] += row.n
                    outcomes.append((interval.number, row.cell, shard, piece, None, None, None, None))
        opened = entered
        levels.append((None, spark.createDataFrame(outcomes, _OUTCOME)))
        if opened:
            inside = spark.createDataFrame([x for x in outcomes if x[4] is not None], _OUTCOME)
            here = _meet(here, inside, "inner")
    starts, last, slot = [], None, 0
    for shard, piece in sorted(sizes):
        slot = slot if shard == last else 0
        starts.append((shard, piece, slot))
        last, slot = shard, slot + sizes[shard, piece]
    return levels, spark.createDataFrame(starts, "shard int, piece long, start long")


def _step(low: int, high: int, cells: int) -> int:
    return max(1, -(-(high - low + 1) // cells))


def _outcomes(interval: _Interval, cells: list[Row]):
    """For each cell of an interval, in order: the cell with its shard and piece, or the interval to probe inside it."""
    edges = [interval.below, *accumulate((c.bytes for c in cells), initial=interval.below)][1:]
    at_edge, inside = Counter(), {}
    for target in interval.targets:
        aim, tolerance, tight = target
        i = max(0, min(len(cells) - 1, bisect_left(edges, aim) - 1))
        near = i if aim - edges[i] <= edges[i + 1] - aim else i + 1
        if abs(edges[near] - aim) <= tolerance or cells[i].n == 1:
            at_edge[near, tight] += 1
        else:
            inside.setdefault(i, []).append(target)
    shard, piece = interval.shard, interval.piece
    for i, cell in enumerate(cells):
        shard, piece = shard + at_edge[i, True], piece + at_edge[i, True] + at_edge[i, False]
        inner = None
        if i in inside:
            part, (low, high) = next(
                (k, cell[key]) for k, key in enumerate(_KEYS) if k >= interval.part and cell[key].low < cell[key].high)
            inner = _Interval(0, part, low, _step(low, high, CELLS * len(inside[i])), edges[i], shard, piece, inside[i])
        yield cell, shard, piece, inner
        for _, _, tight in inside.get(i, ()):
            shard, piece = shard + tight, piece + 1
