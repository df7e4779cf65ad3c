"""Removal of repeated passages: every word of a window that also starts earlier in the corpus.

Three passes over the texts. (1) A count-min sketch over the anchors of all windows. An anchor is the window's
smallest run of ``ANCHOR`` words by hash, so neighbouring windows share it and the sketch takes a sixth of the
keys; a window that occurs twice has an anchor that occurs twice, so the estimate is never too low. (2) Only
windows estimated repeated leave their task, with a 96-bit key; of equal windows in one run of texts just the
first does, the others are known to be repeats. Keys meet in buckets, packed by run and bucket, where a sort finds the
first of all; a window however frequent comes once a run. (3) The word ranges under repeats go to buckets of
documents and return as one list a document, bounded by its words.

Edge cases: a null or blank text has no words and stays; texts under ``size`` words never lose any; rows
without ``doc_id`` neither lose words nor count as earlier; equal rows of one ``doc_id`` count as one
document. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.llm.sketch import is_repeated, repeated_bits, sketch_bits
from tastemesh.llm.tables import Batches, ids, lists
from tastemesh.llm.words import Words, blank_separated, chunks, mix, split_words, windows

ANCHOR = 10
_WORDS = blank_separated()
_RUN = 1 << 19  # windows compared within a task before they are sent
BUCKET_BYTES = 16 << 20  # of text for each bucket of keys: about a million windows at most


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def window_anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start words of all windows, the anchor of each, and the anchors' own occurrences."""
    width = min(ANCHOR, size)
    span = size - width + 1
    at = np.flatnonzero(np.arange(len(words.hashes)) + size <= words.limits())
    starts, runs = windows(words, width)
    if not len(at):
        return at, runs[:0], runs[:0]
    full = np.full(len(words.hashes), np.iinfo(np.uint64).max, np.uint64)
    full[starts] = runs
    least = _slide(full, span, np.minimum)  # least[i]: of the runs that start at i .. i + span - 1
    anchors = least[at]
    # A run is the anchor of some window when the greatest minimum of the windows around it is itself.
    minima = np.zeros(len(full) + span - 1, np.uint64)
    minima[at + span - 1] = anchors
    chosen = _slide(minima, span, np.maximum) == full
    return at, anchors, full[chosen]


def repeated_spans(documents: DataFrame, size: int = 20) -> DataFrame:
    """By ``doc_id`` the ``spans`` (begin, end, ...) of words under windows that also start earlier; they may overlap."""
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    read = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(read // 36)

    def anchors(batch: pa.RecordBatch):
        for piece in chunks(batch):
            yield window_anchors(split_words(piece.column("text"), _WORDS), size)[2]

    repeated = repeated_bits(texts, anchors, bits)

    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, read // BUCKET_BYTES)

    def candidates(batches: Batches) -> Batches:
        held, count = [], 0
        for batch in batches:
            for piece in chunks(batch):
                words = split_words(piece.column("text"), _WORDS)
                at, anchor, _ = window_anchors(words, size)
                keep = is_repeated(repeated.value, anchor, bits)
                at = at[keep]
                row = words.rows()[at]
                key, other = (windows(words, size, base)[1][keep] for base in (0, 0x5DEECE66D))
                held.append((ids(piece).to_numpy()[row], (at - words.first[row]).astype(np.int32), key, other.astype(np.uint32)))
                count += len(at)
                if count >= _RUN:
                    yield from _run(held, size, buckets)
                    held, count = [], 0
        if count:
            yield from _run(held, size, buckets)

    def settle(batches: Batches) -> Batches:
        for held, passed in _by_bucket(batches, ["docs", "begins", "ends", "k1", "k2"]):
            if passed.num_rows:
                yield passed.select(_RANGES)
            if held:
                yield _packed_ranges(*_later(held, size), buckets)

    def gather(batches: Batches) -> Batches:
        for held, _ in _by_bucket(batches, ["docs", "begins", "ends"]):
            if held:
                doc, begin, end = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(doc, kind="stable")
                owners, counts = np.unique(doc, return_counts=True)
                spans = np.stack([begin[order], end[order]], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(owners), lists(pa.array(spans), 2 * counts)], ["doc_id", "spans"])

    ranges = "bucket int, docs binary, begins binary, ends binary"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    found = dealt(texts.mapInArrow(candidates, f"{ranges}, k1 binary, k2 binary"))
    return dealt(found.mapInArrow(settle, ranges)).mapInArrow(gather, "doc_id long, spans array<int>")


_RANGES = ["bucket", "docs", "begins", "ends"]
_KINDS = {"docs": np.int64, "begins": np.int32, "ends": np.int32, "k1": np.uint64, "k2": np.uint32}


def _by_bucket(batches: Batches, columns: list[str]):
    """For each bucket of a sorted partition its unpacked rows, and by batch the rows without one of the columns."""
    bucket, held = None, []
    for batch in batches:
        whole = batch.column(columns[-1]).is_valid()
        yield [], batch.filter(pc.invert(whole))
        batch = batch.filter(whole)
        for number, *packed in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in columns), strict=True):
            if number != bucket and held:
                yield held, batch.slice(0, 0)
                held = []
            bucket = number
            held.append([_unpack(x, _KINDS[c]) for x, c in zip(packed, columns, strict=True)])
    if held:
        yield held, batch.slice(0, 0)


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _unpack(packed: pa.BinaryScalar, kind: type) -> np.ndarray:
    data = packed.as_buffer()
    n = int.from_bytes(data[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, "zstd"), kind)


def _buckets_of(bucket: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """Bucket numbers, and the columns, sorted by bucket, packed for each."""
    numbers, cuts = np.unique(bucket, return_index=True)
    return [pa.array(numbers, pa.int32()), *(pa.array([_pack(x) for x in np.split(v, cuts[1:])] if len(v) else [], pa.binary()) for v in columns)]


def _packed_ranges(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Word ranges by bucket of their document."""
    home = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((begin, doc, home))
    return pa.RecordBatch.from_arrays(_buckets_of(home[order], [v[order] for v in (doc, begin, end)]), _RANGES)


def _run(held: list, size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of one run of texts: the first of each by bucket of its key, the words under the others by document."""
    doc, start, key, other = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((start, doc, other, key))
    doc, start, key, other = doc[order], start[order], key[order], other[order]
    lead, later = _leads(doc, start, key, other)
    first = lead == np.arange(len(doc))
    # Sorted by bucket and place, documents and starts pack to almost nothing.
    bucket = ((key[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((start[first], doc[first], bucket))
    number, docs, begins, k1, k2 = _buckets_of(bucket[order], [v[first][order] for v in (doc, start, key, other)])
    names = [*_RANGES, "k1", "k2"]
    yield pa.RecordBatch.from_arrays([number, docs, begins, pa.array([_pack(np.zeros(0, np.int32))] * len(number), pa.binary()), k1, k2], names)
    known = _packed_ranges(*_covers(doc[later], start[later], size), buckets)
    yield pa.RecordBatch.from_arrays([*known.columns, *[pa.nulls(known.num_rows, pa.binary())] * 2], names)


def _leads(doc, start, key, other) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by key and place: the index of the key's first, and whether a window starts after it.

    Equal rows of one document are one occurrence, as early as the first.
    """
    same = np.zeros(len(doc), bool)
    same[1:] = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    return lead, (doc != doc[lead]) | (start != start[lead])


def _covers(doc: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word ranges under windows: documents, begins, ends."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)
    closes = np.roll(opens, -1)
    return doc[opens], start[opens], start[closes] + np.int32(size)


def _later(held: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word ranges under windows of one bucket that also start earlier."""
    doc, start, key, other = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3, 4))
    order = np.lexsort((start, doc, other, key))
    doc, start = doc[order], start[order]
    _, later = _leads(doc, start, key[order], other[order])
    return _covers(doc[later], start[later], size)


def remove_repeats(documents: DataFrame, size: int = 20) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space."""
    marked = documents.select("doc_id", "text").join(repeated_spans(documents, size), "doc_id", "left")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for piece in chunks(batch):
                counts, removed, kept = [], [], []
                for text, spans in zip(piece.column("text"), piece.column("spans"), strict=True):
                    own = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    stays = np.ones(len(own), bool)
                    if spans.is_valid:
                        edges = np.zeros(len(own) + 1, np.int64)
                        ranges = spans.values.to_numpy()
                        np.add.at(edges, ranges[::2], 1)
                        np.add.at(edges, ranges[1::2], -1)
                        stays = np.cumsum(edges[:-1]) == 0
                    counts.append(len(own))
                    removed.append(len(own) - int(stays.sum()))
                    kept.append(b" ".join(compress(own, stays)))
                yield pa.RecordBatch.from_arrays(
                    [ids(piece), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
