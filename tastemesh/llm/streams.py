"""Sorted rows read as streams inside tasks: one reader a key, never all rows of a key at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from tastemesh.llm.tables import Batches

_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
}
_BATCH = 1 << 12


def streamed(rows: DataFrame, reader: Callable, columns: str) -> DataFrame:
    """Feed rows that come sorted by their first column, the key, to one ``reader(key)`` a key; its results have ``columns``.

    A reader's ``row(*values)`` and ``finish()`` append result rows, as tuples, to its list ``out``.
    """
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def work(batches: Batches) -> Batches:
        own, key, out = None, None, []
        for batch in batches:
            for found, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or found != key:
                    if own is not None:
                        own.finish()
                    own, key = reader(found), found
                    own.out = out
                own.row(*values)
                if len(out) >= _BATCH:
                    yield packed(out)
                    out.clear()
        if own is not None:
            own.finish()
        if out:
            yield packed(out)

    return rows.mapInArrow(work, columns)
