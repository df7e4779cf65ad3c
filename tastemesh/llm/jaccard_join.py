"""Exact Jaccard join of documents on word shingles, and the classes its links form.

Documents with equal shingle sets are one class from the start. Classes meet through prefix signatures: shingles
are ordered from rare to frequent (by a sketch of their counts). A rare shingle is a signature by itself (``k = 1``), those
counted over ``FREQUENT[0]`` times make signatures in pairs, over ``FREQUENT[1]`` times in threes, each within token
classes dealt by a hash. A set's prefix is extended by the ``k - 1`` tokens that a class can share without a signature, so
two sets at the threshold always share one. The classes grow in number with a ladder of set sizes, a set near the upper
end of a step standing on two steps, so the signatures of a set grow in line with its size; sets up to ``SMALL``
shingles use single shingles only.

A signature met by many sets is not expanded into pairs. Each round verifies every member against the signature's hub,
a linear number of pairs, joins what is similar, and goes on with signatures whose members are still in different classes,
those with the same members as one. Rounds end when no signature holds more than ``OPEN_CLASSES`` classes, when less than one
verified pair in ``JOINING`` is similar, after ``HUB_ROUNDS`` at the latest; the pairs left there between classes, all of
them, are verified. A pair meets only where the signature's places in both prefixes leave enough tokens to reach the
threshold: a place bounds the sizes of a set's partners, so the last join has steps of sizes in its key. Of its pairs, those
are left out whose parity bitmaps differ in more cells than similar sets can.

Edge cases: null or blank texts have an empty set and link with nothing; rows without ``doc_id`` get their size and a
null class; equal rows of one ``doc_id`` are one document (texts that differ under one id are the caller's error);
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.llm.components import components
from tastemesh.llm.sketch import is_repeated, repeated_bits, sketch_bits
from tastemesh.llm.tables import Batches, flat, ids, lists
from tastemesh.llm.words import blank_separated, chunks, mix, shingle_sets, split_words
from tastemesh.sources.staging import stage

SHINGLE, PERCENT = 5, 80
FREQUENT = (1000, 50_000)  # shingles counted more often than the first make signatures in pairs, than the second in threes
CLASSES, SMALL = 2, 64
PARITY_BITS, SIZE_STEP = 1024, 1.05
HUB_ROUNDS, OPEN_CLASSES, JOINING = 6, 64, 4
_WORDS = blank_separated()
_COUNT_BITS = (16, 22)  # counters of the order sketch: at most 2 ** 22
_BLOCK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _sets(batch: pa.RecordBatch, shingle: int):
    for piece in chunks(batch):
        yield piece, list(shingle_sets(split_words(piece.column("text"), _WORDS, lower=True), shingle))


def set_keys(documents: DataFrame, shingle: int, bits: int) -> DataFrame:
    """Per document its set size and a 128-bit key of the set; rows with ``block`` carry shingle counts instead."""

    def work(batches: Batches) -> Batches:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for piece, sets in _sets(batch, shingle):
                key = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                if len(key):
                    np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
                    n = len(sets)
                    yield pa.RecordBatch.from_arrays(
                        [ids(piece), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                         pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks = counts.reshape(-1, min(_BLOCK, len(counts)))
        live = np.flatnonzero(blocks.any(axis=1))
        if len(live):
            empty = pa.nulls(len(live), pa.int64())
            packed = [pa.compress(blocks[b].tobytes(), "zstd", asbytes=True) for b in live]
            yield pa.RecordBatch.from_arrays([empty] * 4 + [pa.array(live, pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "n", "k1", "k2", "block", "counts"]
    schema = "doc_id long, n long, k1 long, k2 long, block int, counts binary"
    return documents.select("doc_id", "text").mapInArrow(work, schema)


def _order_sketch(found: DataFrame, bits: int):
    """Broadcast counts of shingles by the top ``bits`` of their hash: 16 MB at most."""
    width = min(_BLOCK, 1 << bits)

    def merge(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(block, np.zeros(width, np.int64))
                own += np.frombuffer(pa.decompress(packed, 4 * width, "zstd"), np.int32)
        if sums:
            data = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["block", "counts"])

    spark = found.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (found.where("block IS NOT NULL").select("block", "counts").repartition(partitions, "block")
            .mapInArrow(merge, "block int, counts binary").toArrow())
    counts = np.zeros(1 << bits, np.int32)
    for block, own in zip(rows["block"].to_pylist(), rows["counts"], strict=True):
        counts[block * width : (block + 1) * width] = np.frombuffer(own.as_buffer(), np.int32)
    return spark.sparkContext.broadcast(counts)


def levels(n: int, percent: int) -> range:
    """The ladder levels at which a set meets sets as large as itself or larger. Level 0 holds sizes up to ``SMALL``, each
    level after it sizes up to twice those of the one before."""
    return range(_level(n), _level(100 * n // percent) + 1)


def _level(n: int) -> int:
    return max(0, (-(-n // SMALL) - 1).bit_length())


def prefix_signatures(tokens: np.ndarray, estimate: np.ndarray, frequent: tuple[int, int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set (sorted distinct token hashes with their estimated counts), and their places.

    At a level, ``k - 1`` tokens of a class of ``k``-combinations may be common without a signature. All tokens beyond
    that are the class's excess, and a prefix ends with the token that makes the excess one more than similar sets can
    have mismatches. A signature's place is the excess before its last token: no more than ``n - place`` tokens are
    common to two sets whose first common signature it is.
    """
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1
    order = np.lexsort((tokens, estimate))
    tokens, estimate = tokens[order], estimate[order]
    sigs, places = [], []
    for level in levels(n, percent):
        salt = np.uint64((0x51ED270B * (level + 1)) % 2**64)
        if level == 0:
            sigs.append(mix(tokens[:need] ^ salt))
            places.append(np.arange(need))
            continue
        classes = CLASSES << level
        allowed = (estimate > frequent[0]).astype(np.int64) + (estimate > frequent[1])
        kind = np.where(allowed > 0, allowed * classes + (mix(tokens) % np.uint64(classes)).astype(np.int64), 0)
        by_kind = np.argsort(kind, kind="stable")
        firsts = np.flatnonzero(np.diff(kind[by_kind], prepend=-1))
        rank = np.empty(n, np.int64)
        rank[by_kind] = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
        excess = np.cumsum(rank >= allowed)
        length = min(n, int(np.searchsorted(excess, need)) + 1)
        own, kind, allowed = tokens[:length], kind[:length], allowed[:length]
        place = excess[:length] - (rank[:length] >= allowed)
        rare = np.flatnonzero(kind == 0)
        sigs.append(mix(own[rare] ^ salt))
        places.append(place[rare])
        for group in np.unique(kind[kind > 0]):
            at = np.flatnonzero(kind == group)
            left, right = np.triu_indices(len(at), 1)
            both = mix(mix(own[at[left]] ^ salt) + own[at[right]] * _STEP)
            if allowed[at[0]] == 1:
                sigs.append(both)
                places.append(place[at[right]])
                continue
            later = len(at) - 1 - right  # a third token for each pair
            last = np.repeat(right + 1, later) + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
            sigs.append(mix(np.repeat(both, later) + own[at[last]] * _STEP))
            places.append(place[at[last]])
    return np.concatenate(sigs), np.concatenate(places).astype(np.int32)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Of each of ``PARITY_BITS`` cells, whether an odd number of tokens falls into it.

    Two sets differ in at least as many tokens as cells.
    """
    odd = np.bincount((mix(tokens ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def classes(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, frequent: tuple[int, int] = FREQUENT,
            hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``n_same``, the documents with the same set."""
    documents = documents.select("doc_id", "text")
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, documents.count()))), *_COUNT_BITS))
    found = stage(set_keys(documents, shingle, bits), "sets")
    docs = found.where("block IS NULL").select("doc_id", "n", "k1", "k2")
    sets = stage(
        docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same")), "set-classes")
    links = _links(documents, sets, _order_sketch(found, bits), bits, shingle, percent, frequent, hub_rounds)
    named = sets.join(links, sets["rep"] == links["node"], "left").select(
        "k1", "k2", "n_same", F.coalesce("component", "rep").alias("component_id"))
    return docs.join(named, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_same")).otherwise(F.lit(1)).alias("n_same"))


def _links(documents, sets, sketch, bits, shingle, percent, frequent, hub_rounds) -> DataFrame:
    """``node``, ``component`` of the set classes that have a link."""
    shift = np.uint64(64 - bits)

    def signatures(batches: Batches) -> Batches:
        noise = 2 * int(sketch.value.mean())  # what other shingles add to a counter
        limit = frequent[0] + noise, frequent[1] + noise
        for batch in batches:
            for piece, own in _sets(batch, shingle):
                none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
                made = [prefix_signatures(s, sketch.value[(s >> shift).astype(np.int64)], limit, percent) if len(s) else none for s in own]
                sigs, places = (np.concatenate(x) for x in zip(*made, strict=True))
                sizes = [len(m[0]) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [ids(piece), pa.array([len(s) for s in own], pa.int32()),
                     lists(pa.array(sigs.view(np.int64)), sizes), lists(pa.array(places), sizes),
                     lists(pa.array(np.concatenate([parity(s) for s in own])), [PARITY_BITS // 64] * len(own))],
                    ["doc_id", "n", "sigs", "places", "bits"])

    reps = sets.select(F.col("rep").alias("doc_id"))
    prefixes = stage(
        documents.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(signatures, "doc_id long, n int, sigs array<long>, places array<int>, bits array<long>")
        .join(reps, "doc_id", "left_semi"), "prefixes")
    count = prefixes.agg(F.sum(F.size("sigs"))).first()[0] or 0
    sig_bits = sketch_bits(count)
    repeated = repeated_bits(prefixes.select("sigs"), lambda b: iter([flat(b.column(0))[0].view(np.uint64)]), sig_bits)

    def shared(batches: Batches) -> Batches:
        for batch in batches:
            sigs, offsets = flat(batch.column("sigs"))
            places = flat(batch.column("places"))[0]
            keep = is_repeated(repeated.value, sigs.view(np.uint64), sig_bits)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs[keep]), batch.column("doc_id").take(pa.array(row)), batch.column("n").take(pa.array(row)),
                 pa.array(places[keep])], ["sig", "doc_id", "n", "place"])

    members = stage(prefixes.drop("bits").mapInArrow(shared, "sig long, doc_id long, n int, place int"), "signatures")
    # Sizes, and what can still be in common from the places on, must allow the threshold.
    fits = f"""{100 + percent} * least(n - place, other_n - other_place) >= {percent} * (n + other_n)
        AND 100 * least(n, other_n) >= {percent} * greatest(n, other_n)"""
    labels = links = pairs = None
    joining = True
    for turn in range(hub_rounds + 1):
        own = members.withColumn("c", F.col("doc_id")) if labels is None else stage(_open(own, labels), "open")
        # Members with few tokens of their own are similar to most others: they make the best hubs.
        pick = F.struct(
            F.floor(100 * F.col("place") / F.col("n")).alias("own"), F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id").alias("other"),
            F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("c").alias("other_c"))
        if turn < hub_rounds and (labels is None or joining and _crowded(own)):
            hubs = own.groupBy("sig").agg(F.min(pick).alias("hub"))
            found = own.join(hubs.select("sig", "hub.*"), "sig").where(f"c <> other_c AND {fits}")
        else:
            hub_rounds = turn  # the last one
            found = _meetings(own.join(prefixes.select("doc_id", "bits"), "doc_id"), fits, percent)
        fresh = found.select(
            F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        if pairs is not None:
            fresh = fresh.join(pairs, ["a", "b"], "left_anti")
        fresh = stage(fresh, "pairs")
        pairs = fresh if pairs is None else pairs.unionByName(fresh)
        tried = fresh.count()
        joining = False
        if tried:
            met = stage(similar_pairs(documents, fresh, shingle, percent), "links")
            links = met if links is None else links.unionByName(met)
            joining = JOINING * met.count() >= tried
        if links is not None:
            labels = stage(components(links), "labels")
        if turn == hub_rounds:
            break
    if labels is None:
        return documents.sparkSession.createDataFrame([], "node long, component long")
    return labels


def _open(own: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of signatures that still hold several classes; signatures of the same members become one.

    Its places are the least of theirs, so no pair is lost. Equal hashes of different member lists only add members.
    """
    named = own.drop("c").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "sig", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("c"))
    lists = named.groupBy("sig").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.xxhash64(
            F.count("*"), F.bit_xor(F.xxhash64("doc_id")), F.bit_xor(F.xxhash64(F.lit(1), "doc_id"))).alias("list")).where("low <> high")
    return named.join(lists, "sig").groupBy(F.col("list").alias("sig"), "doc_id", "n", "c").agg(F.min("place").alias("place"))


def _size_step(n: str) -> str:
    return f"CAST(floor(ln({n}) / ln({SIZE_STEP})) AS int)"


def _meetings(own: DataFrame, fits: str, percent: int) -> DataFrame:
    """Pairs of members of different classes that can still be similar; the larger set looks for the sizes that fit its place."""
    least, most = f"greatest(1, {percent} * n DIV 100)", f"least(n, ({100 + percent} * (n - place)) DIV {percent} - n)"
    larger = own.where(f"{most} >= {least}").select("*", F.explode(F.expr(f"sequence({_size_step(least)}, {_size_step(most)})")).alias("step"))
    smaller = own.select("sig", F.expr(_size_step("n")).alias("step"), *(F.col(x).alias(y) for x, y in (
        ("doc_id", "other"), ("n", "other_n"), ("place", "other_place"), ("c", "other_c"), ("bits", "other_bits"))))
    apart = reduce(add, (F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("other_bits", F.lit(k)))) for k in range(PARITY_BITS // 64)))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("other_n"))
    ordered = "(other_n < n OR other_n = n AND other < doc_id)"
    return larger.join(smaller, ["sig", "step"]).where(F.expr(f"{ordered} AND c <> other_c AND {fits}") & near)


def _crowded(own: DataFrame) -> bool:
    """Whether a signature holds more than about ``OPEN_CLASSES`` classes."""
    most = own.groupBy("sig").agg(F.approx_count_distinct("c").alias("classes")).agg(F.max("classes")).first()[0]
    return (most or 0) > OPEN_CLASSES


def similar_pairs(documents: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (``a``, ``b``) whose sets reach the threshold, with ``common`` and ``total``.

    Texts travel to the pairs, not sets, which are larger. A bitmap of the ids in pairs, of bounded size, keeps
    nearly all other texts where they are.
    """
    bits = sketch_bits(2 * pairs.count())

    def named(batch: pa.RecordBatch):
        for side in ("a", "b"):
            yield np.repeat(mix(batch.column(side).to_numpy().view(np.uint64)), 2)

    wanted = repeated_bits(pairs.select("a", "b"), named, bits)

    def involved(batches: Batches) -> Batches:
        for batch in batches:
            keep = is_repeated(wanted.value, mix(ids(batch).to_numpy().view(np.uint64)), bits)
            yield batch.filter(pa.array(keep))

    def verify(batches: Batches) -> Batches:
        for batch in batches:
            rows = ([], [], [], [])
            for piece in chunks(batch, "x"):
                left, right = (list(shingle_sets(split_words(piece.column(c), _WORDS, lower=True), shingle)) for c in ("x", "y"))
                for a, b, x, y in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), left, right, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    total = len(x) + len(y) - common
                    if common and 100 * common >= percent * total:
                        for out, value in zip(rows, (a, b, common, total), strict=True):
                            out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["a", "b", "common", "total"])

    kept = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(involved, "doc_id long, text string")
    left = pairs.join(kept.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(kept.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, common long, total long")
