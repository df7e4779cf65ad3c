"""Count-min sketches of 64-bit keys: built sparse by partition, merged by cell block in Spark.

One row of ``2**bits`` counters that stop at two, which is all a search for repeated keys asks. A partition
sends each of its cells at most twice, as cell numbers by block; the merge adds them up and returns one bit
a cell: "counted twice or more". Counts are never too low, so every key that repeats has its bit set.
The merged bits have a fixed upper size (``MAX_BITS``), whatever the input, and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tastemesh.llm.tables import Batches

BLOCK_BITS = 16
MIN_BITS, MAX_BITS = 20, 29  # at most 64 MB of bits
_FLUSH = 1 << 22


def sketch_bits(expected: int) -> int:
    """Bits of the cell number for ``expected`` keys: eight cells a key, within the bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, 8 * expected))))))


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.uint32)


def repeated_bits(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """Broadcast bitmap of the cells that count two or more over all keys of ``df``.

    ``keys`` gives arrays of keys for a batch; a key that occurs twice must be given twice.
    """

    def partition_sketch(batches: Batches) -> Batches:
        def blocks(parts: list[np.ndarray]) -> tuple[np.ndarray, pa.RecordBatch]:
            cells, counts = np.unique(np.concatenate(parts), return_counts=True)
            cells = np.repeat(cells, np.minimum(counts, 2))
            numbers, at = np.unique(cells >> np.uint32(BLOCK_BITS), return_index=True)
            low = (cells & np.uint32((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            payload = [x.tobytes() for x in np.split(low, at[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers.astype(np.int32)), pa.array(payload, pa.binary())], ["block", "cells"])

        parts, held = [], 0
        for batch in batches:
            for found in keys(batch):
                parts.append(cells_of(found, bits))
                held += len(found)
                if held >= _FLUSH:
                    yield blocks(parts)
                    parts, held = [], 0
        if held:
            yield blocks(parts)

    def merge(batches: Batches) -> Batches:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, times = np.unique(np.frombuffer(cells.as_buffer(), np.uint16), return_counts=True)
                own = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
                own[found] = np.minimum(own[found] + times, 2)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.int32()), pa.array([np.packbits(x > 1).tobytes() for x in counts.values()])],
                ["block", "repeated"])

    spark = df.sparkSession
    merged = (
        df.mapInArrow(partition_sketch, "block int, cells binary")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
        .mapInArrow(merge, "block int, repeated binary")
    )
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << BLOCK_BITS) // 8
    found = merged.toArrow()  # 8 KB a row, 2 ** (bits - 16) rows: 64 MB at most
    for block, bits_of in zip(found["block"].to_pylist(), found["repeated"], strict=True):
        bitmap[block * width : (block + 1) * width] = np.frombuffer(bits_of.as_buffer(), np.uint8)
    return spark.sparkContext.broadcast(bitmap)


def is_repeated(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """For each key, whether its cell counts two or more."""
    cells = cells_of(keys, bits)
    return (bitmap[cells >> np.uint32(3)] >> (np.uint8(7) - (cells & np.uint32(7)).astype(np.uint8))) & np.uint8(1) == 1
