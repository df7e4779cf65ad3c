"""Benchmark decontamination with a positional inverted index in segments.

``build_index`` stores the postings of all training tokens: a segment covers a run of whole documents and holds,
by term, the sorted positions where it occurs. Segments are independent, so the index is built and
searched without a shuffle, and a term as frequent as any is spread over all segments. ``phrase_matches``
intersects, for all test windows at once, the offset-adjusted positions of the window's rarest term with those of
the next rarest and so on; a window with a term that the segment lacks is dropped at once. ``proximity_matches``
asks instead that each term occurs within ``span`` words of the window's rarest one, in any order; the rarest is that of
all documents (ties: the earliest in the window), whose totals are added up from the postings first, for test terms only.

Test windows go to all segments as broadcast blocks of at most ``BLOCK_WINDOWS``; a larger test set takes
several passes over the stored index. Words are known by a 64-bit hash. A very long text is a segment of its own, held by
one task.

Edge cases: a null or empty text has no words and an item without words occurs nowhere; documents without
``doc_id`` are judged too; equal rows each get a row; repeated items count once by ``item_id``; an item without id is
left out; an empty table gives an empty table, or no hits. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.llm.tables import Batches, ids, lists
from tastemesh.llm.words import alphanumeric, chunks, split_words
from tastemesh.sources.staging import stage

BLOCK_WINDOWS = 200_000  # about 20 MB broadcast
BLOCK_TERMS = 2_000_000  # 16 MB broadcast
SPAN = 20
_WORDS = alphanumeric()
_INDEX = "doc_ids array<long>, firsts array<long>, terms binary, counts binary, positions binary"
_HITS = "doc_id long, seg long, row int, n_words long, items array<long>, begins array<int>, ends array<int>, near array<long>"


def build_index(documents: DataFrame) -> DataFrame:
    """One row a segment: documents, their first positions, and postings (terms, counts, positions)."""

    def segments(batches: Batches) -> Batches:
        for batch in batches:
            for piece in chunks(batch):
                words = split_words(piece.column("text"), _WORDS, lower=True)
                order = np.argsort(words.hashes, kind="stable")
                terms, counts = np.unique(words.hashes, return_counts=True)
                columns = [
                    lists(ids(piece), [piece.num_rows]), lists(pa.array(words.first.astype(np.int64)), [len(words.first)]),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype(np.uint32), order.astype(np.uint32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_ids", "firsts", "terms", "counts", "positions"])

    return documents.select("doc_id", "text").mapInArrow(segments, _INDEX)


def phrase_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """``item_id``, ``terms``: the distinct word windows of each item; a shorter item is one window."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for piece in chunks(batch):
                words = split_words(piece.column("text"), _WORDS, lower=True)
                owner, terms = [], []
                for item, a, b in zip(ids(piece, "item_id").to_pylist(), words.first[:-1], words.first[1:], strict=True):
                    for at in range(a, max(a + (b > a), b - size + 1)):
                        owner.append(item)
                        terms.append(words.hashes[at : min(at + size, b)].view(np.int64))
                if owner:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner, pa.int64()), lists(pa.array(np.concatenate(terms)), [len(x) for x in terms])],
                        ["item_id", "terms"])

    return (
        items.select("item_id", "text").where("item_id IS NOT NULL")
        .mapInArrow(cut, "item_id long, terms array<long>").distinct()
    )


def _one_by_one(batch: pa.RecordBatch):
    """The rows of a batch of segments, of which one at a time is copied."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def term_totals(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``term``, ``total``: how often each term of the windows occurs in all documents; those that never do are left out."""
    terms = stage(windows.select(F.explode("terms").alias("term")).distinct(), "test-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))

    def one(block: int) -> DataFrame:
        rows = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).toArrow()
        wanted = terms.sparkSession.sparkContext.broadcast(np.sort(rows["term"].to_numpy().view(np.uint64)))

        def count(batches: Batches) -> Batches:
            total = np.zeros(len(wanted.value), np.int64)
            for batch in batches:
                for row in _one_by_one(batch):
                    own, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32)
                    if len(own):
                        at = np.minimum(np.searchsorted(own, wanted.value), len(own) - 1)
                        total += np.where(own[at] == wanted.value, counts[at], 0)
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted.value[met].view(np.int64)), pa.array(total[met])], ["term", "total"])

        return index.select("terms", "counts").mapInArrow(count, "term long, total long")

    return reduce(DataFrame.unionByName, map(one, range(blocks))).groupBy("term").agg(F.sum("total").alias("total"))


def anchored(index: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows whose terms all occur somewhere, with the place of the rarest: ``anchor``."""
    places = windows.select("item_id", "terms", F.posexplode("terms").alias("place", "term"))
    return (
        places.join(term_totals(index, windows), "term").groupBy("item_id", "terms")
        .agg(F.count("*").alias("known"), F.min(F.struct("total", "place"))["place"].alias("anchor"))
        .where(F.col("known") == F.size("terms")).drop("known")
    )


def _blocks(windows: DataFrame, size: int):
    """Broadcasts of at most ``BLOCK_WINDOWS`` windows: item ids, lengths, terms padded to ``size``, and anchors if any."""
    windows = stage(windows.withColumn("block_key", F.xxhash64("item_id", "terms")), "test-windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    for block in range(blocks):
        rows = windows.where(F.pmod("block_key", F.lit(blocks)) == block).toArrow()
        terms = np.zeros((rows.num_rows, size), np.int64)
        lengths = rows["terms"].combine_chunks().value_lengths().to_numpy() if rows.num_rows else np.zeros(0, np.int32)
        terms[np.arange(size) < lengths[:, None]] = rows["terms"].combine_chunks().flatten().to_numpy() if rows.num_rows else []
        anchors = rows["anchor"].to_numpy() if "anchor" in rows.column_names else np.zeros(rows.num_rows, np.int64)
        yield windows.sparkSession.sparkContext.broadcast(
            (rows["item_id"].to_numpy(), lengths.astype(np.int64), terms.view(np.uint64), anchors.astype(np.int64)))


class Segment:
    """Postings of one segment; ``keys`` holds (term rank, position) in one sorted array."""

    def __init__(self, row: dict):
        self.doc_ids, self.firsts = row["doc_ids"], np.asarray(row["firsts"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.stride = int(self.firsts[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.stride + self.positions
        self.limits = np.repeat(self.firsts[1:], np.diff(self.firsts))  # end of its document, by position

    def ranks(self, terms: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose terms occur here: their numbers, and term ranks and offsets, rarest first."""
        if not len(self.terms):
            none = np.zeros((0, terms.shape[1]), np.int64)
            return np.zeros(0, np.int64), none, none
        rank = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        live = np.flatnonzero(((self.terms[rank] == terms) | ~used).all(axis=1))
        rank, used = rank[live], used[live]
        offset = np.argsort(np.where(used, self.counts[rank], np.iinfo(np.int64).max), axis=1, kind="stable")
        return live, np.take_along_axis(rank, offset, 1), offset

    def postings(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of each rank, one after the other, and the index of the rank they belong to."""
        sizes = self.counts[ranks]
        owner = np.repeat(np.arange(len(ranks)), sizes)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.positions[(self.ends[ranks] - sizes)[owner] + step], owner

    def phrases(self, lengths: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, and the positions where they start."""
        live, ranks, offsets = self.ranks(terms, np.arange(terms.shape[1]) < lengths[:, None])
        position, owner = self.postings(ranks[:, 0])
        start, size = position - offsets[owner, 0], lengths[live]
        fits = start >= 0
        fits[fits] = self.limits[position[fits]] == self.limits[start[fits]]
        fits &= start + size[owner] <= self.limits[position]
        start, owner = start[fits], owner[fits]
        for k in range(1, terms.shape[1]):
            due = size[owner] > k
            wanted = ranks[owner, k] * self.stride + start + offsets[owner, k]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            stays = ~due | (self.keys[at] == wanted)
            start, owner = start[stays], owner[stays]
        return live[owner], start

    def near(self, lengths: np.ndarray, terms: np.ndarray, anchors: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows whose terms all occur within ``span`` words of their anchor, and where that is."""
        live, ranks, offsets = self.ranks(terms, np.arange(terms.shape[1]) < lengths[:, None])
        position, owner = self.postings(ranks[offsets == anchors[live, None]])
        size, opens = lengths[live], np.repeat(self.firsts[:-1], np.diff(self.firsts))
        for k in range(terms.shape[1]):
            low = ranks[owner, k] * self.stride + np.maximum(position - span, opens[position])
            high = ranks[owner, k] * self.stride + np.minimum(position + span, self.limits[position] - 1)
            at = np.searchsorted(self.keys, low)
            met = self.keys[np.minimum(at, len(self.keys) - 1)]
            stays = (size[owner] <= k) | ((met >= low) & (met <= high))
            position, owner = position[stays], owner[stays]
        return live[owner], position


def _by_document(doc: np.ndarray, item: np.ndarray, n: int) -> pa.Array:
    """The distinct items of each of ``n`` documents."""
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])][: len(doc)]
    return lists(pa.array(item[first], pa.int64()), np.bincount(doc[first], minlength=n))


def _search(index: DataFrame, windows: DataFrame, size: int, find, span: int | None = None) -> DataFrame:
    """By segment document: the items that ``find`` reports and the merged word ranges ``begins`` to ``ends``.

    With a ``span``, ``near`` has the items found by proximity in the same pass, else it is empty.
    """

    def one(block) -> DataFrame:
        def search(batches: Batches) -> Batches:
            item_ids, lengths, terms, anchors = block.value
            for batch in batches:
                for row in _one_by_one(batch):
                    segment = Segment(row)
                    window, begin, end = find(segment, lengths, terms, anchors)
                    doc = np.searchsorted(segment.firsts, begin, "right") - 1
                    cuts = np.searchsorted(np.sort(doc, kind="stable"), np.arange(len(segment.doc_ids) + 1))
                    order = np.argsort(doc, kind="stable")
                    items, begins, ends = [], [], []
                    for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own = order[a:b]
                        items.append(np.unique(item_ids[window[own]]))
                        lo, hi = _merge(begin[own] - segment.firsts[d], end[own] - segment.firsts[d])
                        begins.append(lo)
                        ends.append(hi)
                    n = len(segment.doc_ids)
                    close, place = segment.near(lengths, terms, anchors, span) if span is not None else (window[:0], begin[:0])
                    near = _by_document(np.searchsorted(segment.firsts, place, "right") - 1, item_ids[close], n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(segment.doc_ids, pa.int64()), pa.array([row["seg"]] * n, pa.int64()),
                        pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(segment.firsts)),
                        *(lists(pa.array(np.concatenate(x) if n else [], kind), [len(y) for y in x])
                          for x, kind in ((items, pa.int64()), (begins, pa.int32()), (ends, pa.int32()))), near,
                    ], _HITS.replace(",", " ").split()[::2])

        return index.mapInArrow(search, _HITS)

    found = [one(block) for block in _blocks(windows, size)]
    if len(found) == 1:
        return found[0].drop("seg", "row")
    together = reduce(DataFrame.unionByName, found).groupBy("seg", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "begins", "ends", "near")))
    return together.drop("seg", "row").mapInArrow(_join_ranges, together.drop("seg", "row").schema)


def _join_ranges(batches: Batches) -> Batches:
    """Items and ranges of several blocks as sets of one."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            row["items"], row["near"] = sorted(set(row["items"])), sorted(set(row["near"]))
            row["begins"], row["ends"] = _merge(np.array(row["begins"], np.int32), np.array(row["ends"], np.int32))
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def _merge(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges that cover the given ones."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order].astype(np.int32), np.maximum.accumulate(ends[order]).astype(np.int32)
    if not len(begins):
        return begins, reach
    opens = np.flatnonzero(np.r_[True, begins[1:] > reach[:-1]])
    return begins[opens], reach[np.r_[opens[1:], len(begins)] - 1]


def _stored(documents: DataFrame) -> DataFrame:
    """The index as a stored table, its rows numbered."""
    return stage(build_index(documents).withColumn("seg", F.monotonically_increasing_id()), "postings")


def _exact(segment: Segment, lengths: np.ndarray, terms: np.ndarray, _: np.ndarray):
    window, start = segment.phrases(lengths, terms)
    return window, start, start + lengths[window]


def phrase_matches(index: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: ``n_words``, ``items`` with a window that occurs exactly, and the word ranges they cover."""
    return _search(index, phrase_windows(items, size), size, _exact).drop("near")


def proximity_matches(index: DataFrame, items: DataFrame, size: int = 10, span: int = SPAN) -> DataFrame:
    """As ``phrase_matches``, for windows whose words all occur within ``span`` words of the rarest, in any order.

    The ranges are the places of the rarest word. A word that a window repeats need not be repeated.
    """

    def find(segment: Segment, lengths: np.ndarray, terms: np.ndarray, anchors: np.ndarray):
        window, place = segment.near(lengths, terms, anchors, span)
        return window, place, place + 1

    return _search(index, anchored(index, phrase_windows(items, size)), size, find).drop("near")


def contamination(documents: DataFrame, items: DataFrame, size: int = 10, span: int | None = None) -> DataFrame:
    """Per document the words that lie in a test window (``n_hit``), the ``items`` met, and ``contaminated``.

    With a ``span`` also ``near``, the items met by proximity, exact ones among them where ``size`` is at most ``span``.
    """
    index, windows = _stored(documents), phrase_windows(items, size)
    matches = _search(index, windows if span is None else anchored(index, windows), size, _exact, span)
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return matches.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        (F.size("items") > 0).alias("contaminated"), *(["near"] if span is not None else []))
