"""Arrow helpers that run inside tasks: pair sums of two user blocks, scores of two blocks, n-grams of texts.

Each one walks a partition that Spark has sorted by block pair and holds one block pair at a time, so
its memory is bounded by the block size and not by the data.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Ship these functions inside the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pairs expanded at once, and buffered sums kept before they are folded together.
_CHUNK = 1 << 20
# Neighbours' cells added up at once, about what a processor's cache holds.
_MET = 1 << 17
# Like items in a row whose scores have a bound in common, and a closer one.
_LIKE, _ALIKE = 64, 8
# Words of a text that travel in one row at most, besides those that its last n-grams need.
WORDS_PER_ROW = 1024


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list column without NULL lists."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of equal key in a sorted batch: key, first row, end."""
    cols = [batch.column(k).to_numpy() for k in keys]
    if batch.num_rows == 0:
        return
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    for s, e in zip(starts, [*starts[1:], batch.num_rows]):
        yield tuple(int(c[s]) for c in cols), int(s), int(e)


class _Sums:
    """Several sums per flat index, sparse while few cells are touched, dense beyond that."""

    def __init__(self, size: int, width: int):
        self.size, self.width = size, width
        self.index: list[np.ndarray] = []
        self.values: list[list[np.ndarray]] = []
        self.buffered = 0
        self.dense: np.ndarray | None = None

    def add(self, index: np.ndarray, values: list[np.ndarray]) -> None:
        self.index.append(index)
        self.values.append(values)
        self.buffered += len(index)
        if self.buffered >= max(self.size // 4, _CHUNK):
            self._fold()

    def _fold(self) -> None:
        if self.dense is None:
            self.dense = np.zeros((self.width, self.size))
        index = np.concatenate(self.index)
        for w in range(self.width):
            column = np.concatenate([v[w] for v in self.values])
            self.dense[w] += np.bincount(index, column, self.size)
        self.index, self.values, self.buffered = [], [], 0

    def result(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Touched indexes in order and their sums; the first sum counts the pairs."""
        if self.dense is not None:
            if self.buffered:
                self._fold()
            touched = np.flatnonzero(self.dense[0])
            return touched, [d[touched] for d in self.dense]
        if not self.buffered:
            return np.empty(0, dtype=np.int64), [np.empty(0)] * self.width
        touched, slot = np.unique(np.concatenate(self.index), return_inverse=True)
        columns = [np.concatenate([v[w] for v in self.values]) for w in range(self.width)]
        return touched, [np.bincount(slot, c, len(touched)) for c in columns]


def _cross(left_len: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all (left, right) pairs of each row, a bounded number of pairs at a time.

    A row of ``length`` entries starts with its ``left_len`` left ones.
    """
    begin = np.cumsum(length) - length
    row = np.repeat(np.arange(len(length)), left_len)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(left_len) - left_len, left_len)
    yield from _partners(begin[row] + nth, (begin + left_len)[row], (length - left_len)[row])


def _partners(left: np.ndarray, first_right: np.ndarray, partners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each left position with its ``partners`` many positions from ``first_right`` on, a bounded number of pairs at a time."""
    work = np.cumsum(partners)
    done = 0
    while done < len(left):
        before = work[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(work, before + _CHUNK, side="right")))
        n = partners[done:stop]
        within = np.arange(work[stop - 1] - before) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(left[done:stop], n), np.repeat(first_right[done:stop], n) + within
        done = stop


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as ``n`` says, and the ``n`` many numbers from its ``first`` on."""
    at = np.repeat(np.arange(len(n)), n)
    return at, first[at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]


def _quantize(x: np.ndarray, digits: int) -> np.ndarray:
    scale = float(10**digits)
    return np.floor(x * scale + 0.5) / scale


def _best(owner: np.ndarray, other: np.ndarray, strength: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` strongest per owner, ties by the lower other."""
    order = np.lexsort((other, -strength, owner))
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.r_[True, sorted_owner[1:] != sorted_owner[:-1]]) if len(order) else order
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


def _best_scores(user: np.ndarray, code: np.ndarray, score: np.ndarray, digits: int, k: int | None) -> np.ndarray:
    """Positions of the ``k`` best or all scores of each user, in order of user and rank, ties by the lower code.

    User, score of so many digits and code are one number to sort by, where they fit. The rows of a user are next to each other.
    """
    value = np.rint(score * float(10**digits))
    top, low = (value.max(), value.min()) if len(value) else (0.0, 0.0)
    first, width = (int(user.min()), int(code.max()) + 1) if len(value) else (0, 1)
    span = (top - low + 1) * width
    if not len(value) or not span * (float(user.max()) - first + 1) < 2.0**62:
        return _best(user, code, score, len(user) if k is None else k)
    key = ((top - value).astype(np.int64) * width + code) + (user.astype(np.int64) - first) * int(span)
    if k is None:
        return np.argsort(key)
    starts = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
    n = np.diff(np.r_[starts, len(user)])
    # Of k stretches of a user's rows each has a best one, and the k-th best of all is no worse than the worst of these.
    stretch = (starts[:, None] + n[:, None] * np.arange(k) // k).ravel()
    bound = np.minimum.reduceat(key, stretch).reshape(-1, k).max(axis=1)
    bound[n < k] = np.iinfo(np.int64).max
    near = np.flatnonzero(key <= np.repeat(bound, n))
    order = near[np.argsort(key[near])]
    sorted_user = user[order]
    starts = np.flatnonzero(np.r_[True, sorted_user[1:] != sorted_user[:-1]])
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


def _pearson(n, xy, x, y, xx, yy, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the correlation of these moments is defined, and its value."""
    vx, vy = n * xx - x * x, n * yy - y * y
    defined = (n >= 2) & (vx > 0) & (vy > 0)
    ratio = (n * xy - x * y) / np.sqrt(np.where(defined, vx * vy, 1.0))
    return defined, _quantize(np.clip(ratio, -1.0, 1.0), digits)


class _BlockPair:
    """Ids, squared norms and running sums of one pair of user blocks."""

    def __init__(self, header: pa.RecordBatch, same: bool, measure: str):
        self.same, self.pearson = same, measure == "pearson"
        n_left = header.column("n_left")[0].as_py()
        ids, norms = header.column("ids").flatten(), header.column("val").flatten().to_numpy()
        self.ids = (ids[:n_left], ids[n_left:])
        self.norms = (norms[:n_left], norms[n_left:])
        self.width = len(ids) - n_left
        self.sums = _Sums(n_left * self.width, 6 if self.pearson else 2)

    def add(self, rows: pa.RecordBatch) -> None:
        length, pos = _flat(rows.column("pos"))
        _, val = _flat(rows.column("val"))
        for li, ri in _cross(rows.column("n_left").to_numpy(), length):
            if self.same:
                upper = pos[li] < pos[ri]
                li, ri = li[upper], ri[upper]
            x, y = val[li], val[ri]
            index = pos[li].astype(np.int64) * self.width + pos[ri]
            ones = np.ones(len(x))
            self.sums.add(index, [ones, x * y, x, y, x * x, y * y] if self.pearson else [ones, x * y])

    def result(self, k: int, digits: int) -> pa.RecordBatch:
        index, s = self.sums.result()
        u, v = index // self.width, index % self.width
        n, xy = s[0], s[1]
        if self.pearson:
            defined, sim = _pearson(n, xy, *s[2:], digits)
        else:
            defined = np.ones(len(n), dtype=bool)
            sim = _quantize(xy / np.sqrt(self.norms[0][u] * self.norms[1][v]), digits)
        u, v, n, sim = (a[defined] for a in (u, v, n, sim))
        strength = np.abs(sim) if self.pearson else sim
        forward, backward = _best(u, v, strength, k), _best(v, u, strength, k)
        both = np.r_[forward, backward]
        left, right = self.ids
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([left.take(pa.array(u[forward])), right.take(pa.array(v[backward]))]),
                pa.concat_arrays([right.take(pa.array(v[forward])), left.take(pa.array(u[backward]))]),
                pa.array(sim[both]),
                pa.array(n[both].astype(np.int64)),
            ],
            names=["user_id", "other_id", "sim", "n_common"],
        )


def pair_similarity(
    measure: str, k: int, digits: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by ``(left_block, right_block, part)``.

    The row of ``part`` 0 gives the ids and squared norms of both blocks, those of ``part`` 1 the cells
    of one item in both, left ones first. Yields the ``k`` best of each user of the block pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for (left, right, part), start, end in _runs(batch, ["left_block", "right_block", "part"]):
                if (left, right) != key and state:
                    yield state.result(k, digits)
                key, rows = (left, right), batch.slice(start, end - start)
                if part == 0:
                    state = _BlockPair(rows, left == right, measure)
                else:
                    state.add(rows)
        if state:
            yield state.result(k, digits)

    return run


def _planes(numbers: np.ndarray, n_bytes: int) -> np.ndarray:
    """All lowest bytes of numbers, then all next ones, of which the highest are mostly alike."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T


def _numbers(planes: np.ndarray) -> np.ndarray:
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    return wide.view("<i8").ravel()


def _unpacked(rows: pa.RecordBatch, code_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of ``packed_lists``: their sizes, codes and kinds (none where values travel as they are)."""
    codec, parts = pa.Codec("zstd"), []
    for sizes, packed in zip(rows.column("sizes"), rows.column("packed"), strict=True):
        n, kind_bytes = int(sizes.values.to_numpy().sum()), packed.as_buffer()[0]
        raw = codec.decompress(packed.as_buffer()[1:], n * (code_bytes + kind_bytes))
        parts.append((kind_bytes, np.frombuffer(raw, np.uint8).reshape(-1, n)))
    planes = np.concatenate([p for _, p in parts], axis=1)
    _, length = _flat(rows.column("sizes"))
    length = length.astype(np.int64)
    first = np.cumsum(length) - length
    step = _numbers(planes[:code_bytes])
    code = np.cumsum(step)
    code -= np.repeat((code - step)[first], length)
    return length, code, _numbers(planes[code_bytes:]) if parts[0][0] else np.empty(0, np.int64)


def packed_lists(n_blocks: int, code_bytes: int, kinds: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function from ``code, val, norm``, raters of an item each, to ``block, sizes, packed, val, norm``.

    A list goes to each block that has a rater of it; a row has a block's lists of many items. Codes, at most so many bytes each, are
    in order and travel as distances, by lowest, next and highest bytes, and so do values that are small numbers (``kinds``), all
    compressed; otherwise ``val`` and ``norm`` are lists.
    """
    kind_bytes = 2 if kinds else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("code").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            work = np.cumsum(length * np.minimum(length, n_blocks))
            done = 0
            while done < len(length):
                before = work[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(work, before + 4 * _CHUNK, side="right")))
                yield from one(batch.slice(done, stop - done))
                done = stop

    def one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, code = _flat(rows.column("code"))
        length, (_, val), (_, norm) = length.astype(np.int64), _flat(rows.column("val")), _flat(rows.column("norm"))
        of_row, begin = np.repeat(np.arange(len(length)), length), np.cumsum(length) - length
        order = np.lexsort((code, of_row))
        code, val, norm = code[order].astype(np.int64), val[order], norm[order] if len(norm) else norm
        step = np.diff(code, prepend=0)
        step[begin[length > 0]] = code[begin[length > 0]]
        pairs = np.unique(code % n_blocks * len(length) + of_row)
        if not len(pairs):
            return
        block, row = pairs // len(length), pairs % len(length)
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sizes, lists = length[row], np.r_[first, len(block)].astype(np.int32)
        ends = np.r_[0, np.cumsum(sizes)][lists].astype(np.int32)
        _, entry = _spread(begin[row], sizes)
        planes = np.concatenate([_planes(step[entry], code_bytes), _planes(val[entry], kind_bytes)] if kinds else [_planes(step[entry], code_bytes)])
        codec = pa.Codec("zstd", compression_level=1)
        packed = [bytes([kind_bytes]) + codec.compress(planes[:, s:e].tobytes(), asbytes=True) for s, e in zip(ends, ends[1:])]

        def of_block(values: np.ndarray, there: bool) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(ends if there else ends * 0), pa.array(values[entry] if there else values[:0]))

        yield pa.RecordBatch.from_arrays(
            [pa.array(block[first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(lists), pa.array(sizes.astype(np.int32))),
             pa.array(packed, pa.binary()), of_block(val, not kinds), of_block(norm, len(norm) > 0)],
            names=["block", "sizes", "packed", "val", "norm"])

    return run


class _GatheredBlock:
    """Ids and squared norms of one block of users, and their running sums with everyone they meet."""

    def __init__(self, header: pa.RecordBatch, measure: str, n_blocks: int, kinds: np.ndarray | None, code_bytes: int):
        self.pearson, self.n_blocks, self.kinds, self.code_bytes = measure == "pearson", n_blocks, kinds, code_bytes
        self.ids, self.norms = header.column("ids").flatten(), header.column("norm").flatten().to_numpy()
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.buffered = 0
        self.keys: tuple[np.ndarray, np.ndarray] | None = None
        self.sums: list[np.ndarray] = []

    def add(self, block: int, part: int, rows: pa.RecordBatch) -> None:
        _, val = _flat(rows.column("val"))
        if part == 2:
            length, code, kinds = _unpacked(rows, self.code_bytes)
            n_left, val = np.zeros(len(length), np.int64), val if self.kinds is None else kinds
        else:
            length, code = _flat(rows.column("code"))
            code, n_left = code.astype(np.int64), rows.column("n_left").to_numpy()
        _, norm = _flat(rows.column("norm"))
        if self.kinds is not None:
            val, norm = self.kinds[0][val], norm if self.pearson else self.kinds[1][val]
        begin = np.cumsum(length) - length
        row = np.repeat(np.arange(len(length)), length)
        # A row's left ones come first, or are those of its raters that are in the block.
        nth = np.arange(len(code)) - begin[row]
        left = np.flatnonzero(np.where(n_left[row] > 0, nth < n_left[row], code % self.n_blocks == block))
        first = (begin + n_left)[row[left]]
        for li, ri in _partners(left, first, (length - n_left)[row[left]]):
            different = code[li] != code[ri]
            li, ri = li[different], ri[different]
            self.pairs.append((code[li] // self.n_blocks, code[ri], val[li], val[ri], *([] if self.pearson else [norm[ri]])))
            self.buffered += len(li)
            if self.buffered >= max(2 * _CHUNK, len(self.sums[0]) if self.sums else 0):
                self._fold()

    def _fold(self) -> None:
        """Add up what was buffered, by pair in order of user and other; moments of whole numbers are exact in any order."""
        if not self.buffered:
            return
        u, v, x, y, *norm = (np.concatenate(c) for c in zip(*self.pairs))
        self.pairs, self.buffered = [], 0
        new = [np.ones(len(x)), x * y, x, y, x * x, y * y] if self.pearson else [np.ones(len(x)), x * y, *norm]
        if self.keys:
            u, v = (np.concatenate(c) for c in zip(self.keys, (u, v)))
            new = [np.concatenate(c) for c in zip(self.sums, new)]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        self.keys = (u[starts], v[starts])
        self.sums = [np.add.reduceat(c[order], starts) for c in (new if self.pearson else new[:2])]
        if not self.pearson:
            self.sums.append(new[2][order][starts])

    def result(self, k: int, digits: int) -> pa.RecordBatch | None:
        self._fold()
        if not self.keys:
            return None
        (u, v), (n, xy, *rest) = self.keys, self.sums
        if self.pearson:
            defined, sim = _pearson(n, xy, *rest, digits)
            u, v, n, sim = (a[defined] for a in (u, v, n, sim))
        else:
            sim = _quantize(xy / np.sqrt(self.norms[u] * rest[0]), digits)
        best = _best(u, v, np.abs(sim) if self.pearson else sim, k)
        u, v, n, sim = (a[best] for a in (u, v, n, sim))
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else u
        rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)])) + 1
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(u)), pa.array(v), pa.array(sim), pa.array(n.astype(np.int64)), pa.array(rank.astype(np.int32))],
            names=["user_id", "other", "sim", "n_common", "rank"])


def gathered_similarity(
    measure: str, k: int, digits: int, n_blocks: int, kinds: list[tuple] | None = None, code_bytes: int = 8
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by ``(block, part)``.

    The row of ``part`` 0 gives the ids and squared norms of the block's users, those of ``part`` 1 raters of one item,
    with values (and norms), or with places of both in ``kinds`` if given, those of ``part`` 2 the lists of ``packed_lists``.
    Yields ``user_id, other, sim, n_common, rank`` of the ``k`` best of each user; ``other`` is a number.
    """
    known = None if kinds is None else np.array(kinds, dtype=np.float64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            code = batch.schema.field("code").type.value_type
            for (block, part), start, end in _runs(batch, ["block", "part"]):
                rows = batch.slice(start, end - start)
                if part == 0:
                    if state and (out := state.result(k, digits)):
                        yield out.set_column(1, "other", out.column("other").cast(code))
                    state = _GatheredBlock(rows, measure, n_blocks, known, code_bytes)
                else:
                    state.add(block, part, rows)
        if state and (out := state.result(k, digits)):
            yield out.set_column(1, "other", out.column("other").cast(code))

    return run


class _ScoreBlock:
    """Scores of one block of users against one block of items."""

    def __init__(self):
        self.users: list[pa.Array] = []
        self.profiles: list[tuple[np.ndarray, ...]] = []
        self.items: list[pa.Array] = []
        self.scored: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen_pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.by_term: np.ndarray | None = None

    def add(self, part: int, rows: pa.RecordBatch) -> None:
        length, col = _flat(rows.column("cols"))
        row = np.repeat(rows.column("row").to_numpy(), length)
        if part == 2:
            self.seen_pairs.append((row, col))
            return
        _, val = _flat(rows.column("vals"))
        if part == 0:
            self.users.append(rows.column("user"))
            self.profiles.append((row, col, val))
        else:
            self.items.append(rows.column("item"))
            # Hashed blocks may be empty; items without users have nothing to be scored against.
            if self.users:
                self._open()
                self._score(row, col, val)

    def _open(self) -> None:
        """The users' profiles as a dense matrix of their terms, sorted by hash, and users."""
        if self.by_term is not None:
            return
        self.n_users = sum(len(u) for u in self.users)
        row, col, val = (np.concatenate(c) for c in zip(*self.profiles))
        self.terms, at = np.unique(col, return_inverse=True)
        self.by_term = np.zeros((len(self.terms), self.n_users))
        self.by_term[at, row] = val
        self.user_norms = np.sqrt((self.by_term**2).sum(axis=0))

    def _score(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        if len(item) == 0:
            return
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        ends = np.r_[starts[1:], len(item)]
        at_once = max(1, 2 * _CHUNK // max(1, self.n_users))
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + at_once, side="right")))
            part = slice(starts[first], ends[last - 1])
            at = starts[first:last] - starts[first]
            t, w = term[part], weight[part]
            norms = np.sqrt(np.add.reduceat(w * w, at))
            # Terms that are in no profile add nothing.
            place = np.minimum(np.searchsorted(self.terms, t), max(0, len(self.terms) - 1))
            known = self.terms[place] == t if len(self.terms) else np.zeros(len(t), dtype=bool)
            rows = self.by_term[place] if len(self.terms) else np.zeros((len(t), self.n_users))
            rows *= np.where(known, w, 0.0)[:, None]
            dots = np.add.reduceat(rows, at, axis=0)
            scale = norms[:, None] * self.user_norms[None, :]
            np.divide(dots, scale, out=dots, where=scale > 0)
            self.scored.append((item[starts[first:last]], dots))
            first = last

    def result(self, k: int, include_zero: bool, digits: int) -> pa.RecordBatch | None:
        if not self.users or not self.items:
            return None
        users, items = pa.concat_arrays(self.users), pa.concat_arrays(self.items)
        scores = np.zeros((len(users), len(items)))
        for at, dots in self.scored:
            scores[:, at] = dots.T
        scores = _quantize(scores, digits)
        seen = np.zeros(scores.shape, dtype=bool)
        for row, col in self.seen_pairs:
            seen[row, col] = True
        wanted = ~seen if include_zero else ~seen & (scores > 0)
        if len(items) > k:
            cost = np.where(wanted, -scores, np.inf)
            limit = np.partition(cost, k - 1, axis=1)[:, k - 1 : k]
            better, equal = cost < limit, cost == limit
            room = k - better.sum(axis=1, keepdims=True)
            wanted &= better | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room))
        u, i = np.nonzero(wanted)
        return pa.RecordBatch.from_arrays(
            [users.take(pa.array(u)), items.take(pa.array(i)), pa.array(scores[u, i])],
            names=["user_id", "item_id", "score"],
        )


def profile_scores(
    k: int, include_zero: bool, digits: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by ``(user_block, item_block, part, row)``.

    Part 0 has the users of the block with their profiles, part 1 the items with their vectors, part 2
    the seen pairs. Yields ``user_id, item_id, score`` of the ``k`` best unseen items per user of the
    block pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for (users, items, part), start, end in _runs(batch, ["user_block", "item_block", "part"]):
                if (users, items) != key:
                    if state and (out := state.result(k, include_zero, digits)):
                        yield out
                    key, state = (users, items), _ScoreBlock()
                state.add(part, batch.slice(start, end - start))
        if state and (out := state.result(k, include_zero, digits)):
            yield out

    return run


class _Predictions:
    """One block of users: their neighbours, and the best or all scores of what those have and the users have not."""

    def __init__(self, measure: str, kinds: np.ndarray | None, bounds: tuple[float, float] | None, digits: int, k: int | None):
        self.pearson = measure == "pearson"
        self.kinds, self.bounds, self.digits, self.k = kinds, bounds, digits, k
        self.own: list[tuple[pa.Array, np.ndarray]] = []
        self.near: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        self.users: pa.Array | None = None
        self.rows: list[pa.RecordBatch] = []
        self.part: int | None = None
        self.kept: list[tuple[np.ndarray, ...]] = []

    def add(self, part: int, rows: pa.RecordBatch) -> None:
        if part == 0:
            self.own.append((rows.column("user"), rows.column("mean").to_numpy(zero_copy_only=False)))
        elif part == 1:
            length, (_, sim) = rows.column("others").value_lengths().to_numpy(zero_copy_only=False), _flat(rows.column("means"))
            begin = np.cumsum(length, dtype=np.int64) - length
            first = np.arange(int(length.sum())) < np.repeat(begin + length // 2, length)
            both = rows.column("others").flatten()
            self.near.append((both.filter(pa.array(first)), both.filter(pa.array(~first)), sim))
        else:
            if part != self.part:
                self._score()
                self.part = part
            self.rows.append(rows)

    def _open(self) -> None:
        """Users by place, and whose cells each of them meets: the neighbours', and its own, without similarity."""
        self.users = pa.concat_arrays([u for u, _ in self.own])
        self.mean = np.concatenate([m for _, m in self.own])
        place = [pc.fill_null(pc.index_in(u, value_set=self.users), -1).to_numpy(zero_copy_only=False) for u, _, _ in self.near]
        n = len(self.users)
        user = np.concatenate([*place, np.arange(n, dtype=np.int32)])
        other = pa.concat_arrays([*(o for _, o, _ in self.near), self.users])
        sim = np.concatenate([*(s for _, _, s in self.near), np.full(n, np.nan)])
        self.near = []
        self.others = pc.unique(other)
        at = pc.index_in(other, value_set=self.others).to_numpy(zero_copy_only=False)
        order = np.argsort(user, kind="stable")[np.count_nonzero(user < 0):]
        self.user, self.at, self.sim = user[order], at[order], sim[order]
        self.other_mean = np.zeros(len(self.others))
        self.own = []

    def _score(self) -> None:
        """Score what the users meet in the rows of one part, which have all cells of some items."""
        rows, self.rows = self.rows, []
        if self.own:
            self._open()
        if not rows or self.users is None:
            return
        other = pa.concat_arrays([r.column("others").flatten() for r in rows])
        size, code, val = (np.concatenate([_flat(r.column(c))[1] for r in rows]) for c in ("sizes", "codes", "vals"))
        mean = np.concatenate([_flat(r.column("means"))[1] for r in rows])
        at = pc.fill_null(pc.index_in(other, value_set=self.others), -1).to_numpy(zero_copy_only=False)
        if len(mean):
            self.other_mean[at[at >= 0]] = mean[at >= 0]
        if not len(code):
            return
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        # The rows of each other one are next to each other in this order.
        by_other = np.argsort(at, kind="stable")[np.count_nonzero(at < 0):]
        n_rows = np.bincount(at[by_other], minlength=len(self.others))
        first = np.cumsum(n_rows) - n_rows
        work = np.cumsum(np.bincount(at[by_other], size[by_other], len(self.others))[self.at])
        ends = np.flatnonzero(np.r_[self.user[1:] != self.user[:-1], True]) + 1
        done, user_no = 0, 0
        while done < len(self.user):
            before = work[done - 1] if done else 0
            stop_no = max(user_no + 1, int(np.searchsorted(work[ends - 1], before + _MET, side="right")))
            stop = int(ends[stop_no - 1])
            met = slice(done, stop)
            ref, row = _spread(first[self.at[met]], n_rows[self.at[met]])
            row = by_other[row]
            within, cell = _spread(begin[row], size[row])
            ref = ref[within] + done
            value = val[cell] if self.kinds is None else self.kinds[val[cell]]
            self._keep(*self._sums(ref, code[cell], value))
            done, user_no = stop, stop_no
        if self.k is not None:
            self._merge()

    def _sums(self, ref: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        """``user, code, score, support`` in order of user and code from the cells that each neighbour adds.

        Sums are those of ``exact_sum``: whole numbers of 1e-9 and 1e-18.
        """
        sim = self.sim[ref]
        seen = np.isnan(sim)
        dev = value - self.other_mean[self.at[ref]]
        use = seen | ((value != 0) & ~np.isnan(dev))
        ref, code, sim, seen, dev = ref[use], code[use].astype(np.int64), sim[use], seen[use], dev[use]
        user = self.user[ref].astype(np.int64)
        if not len(user):
            return user, code, dev, dev
        width = int(code.max()) + 1
        key = (user - user[0]) * width + code
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        seen, sim = seen[order], sim[order]
        sim[seen] = 0.0

        def exact(x: np.ndarray) -> np.ndarray:
            high = np.floor(x * 1e9)
            low = np.floor((x * 1e9 - high) * 1e9 + 0.5).astype(np.int64)
            total = np.add.reduceat(high.astype(np.int64), starts).astype(np.float64)
            return (total + np.add.reduceat(low, starts).astype(np.float64) / 1e9) / 1e9

        num, den = exact(sim * dev[order]), exact(np.abs(sim))
        wanted = (den > 0) & ~np.logical_or.reduceat(seen, starts)
        key, num, den = key[starts][wanted], num[wanted], den[wanted]
        user, code = key // width + user[0], key % width
        score = num / den
        if self.pearson:
            score = self.mean[user] + score
        if self.bounds:
            score = np.maximum(self.bounds[0], np.minimum(self.bounds[1], score))
        return user, code, _quantize(_quantize(score, 10), self.digits), _quantize(_quantize(den, 10), 4)

    def _keep(self, user, code, score, support) -> None:
        best = slice(None) if self.k is None else _best_scores(user, code, score, self.digits, self.k)
        self.kept.append((user[best].astype(np.int32), code[best], score[best], support[best]))

    def _merge(self) -> None:
        """One list of what was kept, in order of user and rank."""
        kept = [np.concatenate(c) for c in zip(*self.kept)]
        if self.k is not None:
            by_user = np.argsort(kept[0], kind="stable")
            kept = [c[by_user] for c in kept]
        best = _best_scores(*kept[:3], self.digits, self.k)
        self.kept = [tuple(c[best] for c in kept)]

    def result(self) -> Iterator[pa.RecordBatch]:
        self._score()
        if not self.kept:
            return
        self._merge()
        user, code, score, support = self.kept[0]
        starts = np.flatnonzero(np.r_[True, user[1:] != user[:-1]]) if len(user) else user
        rank = (np.arange(len(user)) - np.repeat(starts, np.diff(np.r_[starts, len(user)])) + 1).astype(np.int32)
        for s in range(0, len(user), _CHUNK // 8):
            part = slice(s, s + _CHUNK // 8)
            yield pa.RecordBatch.from_arrays(
                [self.users.take(pa.array(user[part])), pa.array(code[part]), pa.array(score[part], mask=np.isnan(score[part])),
                 pa.array(support[part]), pa.array(rank[part])],
                names=["user_id", "code", "score", "support", "rank"])


def packed_neighbors() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function from ``block, user_id, other_id, sim`` to a row a block: ``others``, first all users and then all others, and ``means``, the sims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.take(pc.sort_indices(batch, sort_keys=[("block", "ascending"), ("user_id", "ascending")]))
            block, n = rows.column("block").to_numpy(), rows.num_rows
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.r_[starts[1:], n]
            at = np.concatenate([np.r_[s:e, n + s : n + e] for s, e in zip(starts, ends)])
            both = pa.concat_arrays([rows.column("user_id"), rows.column("other_id")]).take(pa.array(at))
            to = np.r_[0, ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[starts]), pa.ListArray.from_arrays(pa.array(2 * to), both), pa.ListArray.from_arrays(pa.array(to), rows.column("sim"))],
                names=["block", "others", "means"])

    return run


def predictions(
    measure: str, kinds: list[float] | None, bounds: tuple[float, float] | None, digits: int, k: int | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by ``(block, part)``: ``user_id, code, score, support, rank`` of each user's unseen items.

    Part 0 has the block's users with their means, part 1 their neighbours as ``packed_neighbors`` gives them, later parts the cells of users they may meet,
    several users a row: ``others, sizes``, the items' ``codes`` and ``vals``, which are places in ``kinds`` if given. A part has
    all cells of its items. ``means``, where not empty, are those of ``others``, and come no later than their first cells.
    """
    known = None if kinds is None else np.array(kinds, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for (block, part), start, end in _runs(batch, ["block", "part"]):
                if block != key:
                    if state:
                        yield from state.result()
                    key, state = block, _Predictions(measure, known, bounds, digits, k)
                state.add(part, batch.slice(start, end - start))
        if state:
            yield from state.result()

    return run


class _Filled:
    """Values that come in pieces, in one array of at most ``n`` if known, so that no piece is kept besides."""

    def __init__(self, n: int | None):
        self.n, self.end = n, 0
        self.all: np.ndarray | None = None

    def put(self, values: np.ndarray) -> None:
        if self.all is None:
            self.all = np.empty(self.n or len(values), values.dtype)
        if self.end + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.end], np.empty(self.end + len(values), values.dtype)])
        self.all[self.end : self.end + len(values)] = values
        self.end += len(values)

    def close(self) -> np.ndarray:
        return np.empty(0) if self.all is None else self.all[: self.end]


class _Catalog:
    """Items in catalog order with their vectors; ranks them for one user after the other."""

    def __init__(self, weight_digits: int):
        self.weight_digits = weight_digits
        self.rows: list[tuple] = []
        self.items: pa.Array | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append((rows.column("items").flatten(), *(_flat(rows.column(c))[1] for c in ("places", "cols")), self._weights(rows)))

    def _weights(self, rows: pa.RecordBatch) -> np.ndarray:
        """Weights as they are, or from whole numbers of so many digits."""
        _, vals = _flat(rows.column("vals"))
        _, ints = _flat(rows.column("ints"))
        return ints / float(10**self.weight_digits) if len(ints) else vals

    def close(self) -> None:
        if self.items is not None:
            return
        self.items = pa.concat_arrays([r[0] for r in self.rows])
        sizes, self.cols, self.vals = (np.concatenate([r[i] for r in self.rows]) for i in (1, 2, 3))
        self.rows = []
        self.filled = np.flatnonzero(sizes)
        self.ends = np.cumsum(sizes, dtype=np.int64)[self.filled]
        self.starts = self.ends - sizes[self.filled]
        self.norms = np.empty(len(self.filled))
        for part, at, entries in self._chunks():
            self.norms[part] = np.sqrt(np.add.reduceat(self.vals[entries] ** 2, at))

    def _chunks(self) -> Iterator[tuple[slice, np.ndarray, slice]]:
        """The items with terms, so many at a time that a processor's cache holds their entries."""
        first = 0
        while first < len(self.filled):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + _CHUNK // 16, side="right")))
            yield slice(first, last), self.starts[first:last] - self.starts[first], slice(self.starts[first], self.ends[last - 1])
            first = last

    def ranked(self, cols: np.ndarray, vals: np.ndarray, seen: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all items in the order of a user's ranking, and their scores, of which the seen items at the end have none.

        Score and place are one number to sort by: a score of so many digits and a place take 32 bits each.
        """
        scale, place = float(10**digits), np.arange(len(self.items), dtype=np.uint64)
        value = np.zeros(len(place))
        norm = np.sqrt((vals * vals).sum())
        if norm > 0 and len(self.filled):
            profile = np.zeros(max(int(cols.max()), int(self.cols.max())) + 1)
            profile[cols] = vals
            for part, at, entries in self._chunks():
                dots = np.add.reduceat(self.vals[entries] * profile[self.cols[entries]], at)
                value[self.filled[part]] = np.floor(dots / (self.norms[part] * norm) * scale + 0.5)
        key = (2 * scale - value).astype(np.uint64)
        key[seen] = 2**32 - 1
        key <<= np.uint64(32)
        key |= place
        key.sort()
        return (key & np.uint64(2**32 - 1)).astype(np.int64), (2 * scale - (key >> np.uint64(32)).astype(np.float64)) / scale


def catalog_ranks(digits: int, weight_digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by ``(part, nth)``: ``user_id, item_id, score, rank`` of every item for each user.

    Part 0 has the items in order, several a row, with the sizes of their vectors as ``places`` and weights as ``vals`` or, as whole
    numbers, ``ints``; part 1 the users with their profiles and the places of the items they have seen, which come last and
    without a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog = _Catalog(weight_digits)
        for batch in batches:
            for (part,), start, end in _runs(batch, ["part"]):
                rows = batch.slice(start, end - start)
                if part == 0:
                    catalog.add(rows)
                    continue
                if catalog.items is None and not catalog.rows:
                    continue
                catalog.close()
                n = len(catalog.items)
                for user, cols, vals, seen in zip(*(rows.column(c) for c in ("user", "cols", "vals", "places")), strict=True):
                    cols, vals, seen = (x.values.to_numpy() for x in (cols, vals, seen))
                    order, score = catalog.ranked(cols, vals, seen, digits)
                    for s in range(0, n, _CHUNK // 8):
                        e = min(n, s + _CHUNK // 8)
                        rank = np.arange(s + 1, e + 1, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(user, e - s), catalog.items.take(pa.array(order[s:e])),
                             pa.array(score[s:e], mask=rank > n - len(seen)), pa.array(rank)],
                            names=["user_id", "item_id", "score", "rank"])

    return run


class _LikeItems:
    """Items with their vectors, like items next to each other; finds the best for some users at a time.

    Of ``_LIKE`` items in a row, and again of ``_ALIKE``, the largest weights by term bound what any of them can score. The items
    of the highest bounds are scored first, others only where both bounds reach the ``k``-th best score found. Weights are not negative.
    """

    def __init__(
        self, k: int, include_zero: bool, digits: int, weight_digits: int = 8, n_items: int | None = None, n_entries: int | None = None,
        profiles: bool = False,
    ):
        self.k, self.include_zero, self.digits, self.unit, self.profiles = k, include_zero, digits, float(10**weight_digits), profiles
        self.kept: list[pa.Array] = []
        self.columns = {name: _Filled(n) for name, n in (("places", n_items), ("sizes", n_items), ("cols", n_entries), ("vals", n_entries))}
        self.items: pa.Array | None = None
        self.scored = 0

    def add(self, rows: pa.RecordBatch) -> None:
        if not self.kept:
            self.first_pos = int(rows.column("nth")[0].as_py())
        items = rows.column("items").flatten()
        # A copy, since a piece of a batch keeps all of it in memory.
        self.kept.append(items.take(pa.array(np.arange(len(items)))))
        for name in ("places", "sizes", "cols"):
            self.columns[name].put(_flat(rows.column(name))[1])
        whole = "ints" in rows.schema.names and len(rows.column("ints").flatten()) > 0
        if len(vals := _flat(rows.column("ints" if whole else "vals"))[1]):
            self.columns["vals"].put(vals)

    def close(self) -> None:
        if self.items is not None:
            return
        place, sizes, self.cols, self.vals = (self.columns[c].close() for c in ("places", "sizes", "cols", "vals"))
        self.columns = {}
        # Items that are not scored come last and have no place; before these, items without terms, which score 0.
        n = int(np.count_nonzero(place >= 0))
        self.items, self.kept = pa.concat_arrays(self.kept)[:n], []
        self.place, self.by_place = place[:n], np.argsort(place[:n])
        self.all_sizes = sizes
        self.all_starts = np.cumsum(sizes, dtype=np.int64) - sizes
        n_filled = np.count_nonzero(sizes[:n])
        self.sizes, self.starts = sizes[:n_filled], self.all_starts[:n_filled]
        self.n_terms = int(self.cols.max()) + 1 if len(self.cols) else 1
        self.norms = np.empty(len(self.sizes))
        for first in range(0, len(self.sizes), _CHUNK // 16):
            items = slice(first, min(first + _CHUNK // 16, len(self.sizes)))
            begin, end = self.starts[first], self.starts[items.stop - 1] + self.sizes[items.stop - 1]
            self.norms[items] = np.sqrt(np.add.reduceat(self._weights(slice(begin, end)) ** 2, self.starts[items] - begin))
        self.coarse, self.fine = self._maxima(_LIKE), self._maxima(_ALIKE)
        # Bounds are sums of rounded numbers: never less than what they bound with this.
        longest = max((int(most[3].max()) for most in (self.coarse, self.fine) if len(most[3])), default=0)
        self.slack = 1 + (longest + 4) * 2 * float(np.finfo(np.float32).eps)

    def _weights(self, entries: slice | np.ndarray) -> np.ndarray:
        """Weights as they are, or from whole numbers."""
        vals = self.vals[entries]
        return vals / self.unit if vals.dtype.kind == "i" else vals

    def _profiles(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``user, col, val`` of the users' profiles in this order: as they came, or the means of the vectors of what they have seen."""
        if not self.profiles:
            (size, cols), (_, vals) = (_flat(rows.column(c)) for c in ("cols", "vals"))
            return np.repeat(np.arange(len(size)), size), cols, vals
        (n_seen, seen), (_, times) = (_flat(rows.column(c)) for c in ("places", "times"))
        at, entry = _spread(self.all_starts[seen], self.all_sizes[seen])
        user, whole = np.repeat(np.arange(len(n_seen)), n_seen)[at], self.vals[entry]
        if whole.dtype.kind != "i":
            whole = np.floor(whole * self.unit + 0.5)
        # Sums of whole numbers below 2^53 are exact.
        totals = np.bincount(user * self.n_terms + self.cols[entry], times[at] * whole.astype(np.float64), len(n_seen) * self.n_terms)
        found = np.flatnonzero(totals)
        user = found // self.n_terms
        return user, found % self.n_terms, totals[found] / self.unit / rows.column("matched").to_numpy()[user]

    def _maxima(self, like: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms and largest weights in vectors of length one of each stretch of ``like`` items, and the stretches' first entries and sizes."""
        cols, most, n, at_once = [np.empty(0, self.cols.dtype)], [np.empty(0, np.float32)], [np.empty(0, np.int64)], _CHUNK // 16 // like * like
        for first in range(0, len(self.sizes), at_once):
            items = slice(first, min(first + at_once, len(self.sizes)))
            part = slice(self.starts[first], self.starts[items.stop - 1] + self.sizes[items.stop - 1])
            unit = self._weights(part) / np.repeat(np.maximum(self.norms[items], 1e-300), self.sizes[items])
            key = np.repeat(np.arange(items.stop - first) // like, self.sizes[items]) * self.n_terms + self.cols[part]
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            cols.append((key[at] % self.n_terms).astype(self.cols.dtype))
            most.append(np.maximum.reduceat(unit[order], at).astype(np.float32))
            n.append(np.bincount(key[at] // self.n_terms))
        n = np.concatenate(n)
        return np.concatenate(cols), np.concatenate(most), np.cumsum(n) - n, n

    def batches(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """So many users at a time that a processor's cache holds their profiles."""
        self.close()
        at_once = max(1, min(64, (1 << 22) // self.n_terms))
        for s in range(0, rows.num_rows, at_once):
            yield self._best(rows.slice(s, at_once))

    def _best(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        n, k = rows.num_rows, self.k
        user, cols, vals = self._profiles(rows)
        n_seen, seen = _flat(rows.column("places"))
        norms = np.sqrt(np.bincount(user, vals * vals, n))
        # Terms that no item of this part has add nothing to a score here.
        known = cols < self.n_terms
        weights = np.zeros((n, self.n_terms))
        weights[user[known], cols[known]] = vals[known]
        owner, seen = np.repeat(np.arange(n), n_seen), seen - self.first_pos
        here = (seen >= 0) & (seen < len(self.items))
        seen = np.sort(owner[here] * len(self.items) + seen[here])

        bounds = self._bounds(weights / np.maximum(norms, 1e-300)[:, None])
        goal, done = np.zeros(n), np.zeros(bounds.shape, bool)
        # Stretches enough to hold k items that the user has not seen, and some more.
        wanted = np.minimum(3 + -(-(k + n_seen) // _LIKE), bounds.shape[1])
        for m in np.unique(wanted[wanted > 0]):
            some = np.flatnonzero(wanted == m)
            done[some[:, None], np.argpartition(bounds[some], -m, axis=1)[:, -m:]] = True
        done &= bounds > 0
        found = self._scores(*np.nonzero(done), _LIKE, weights, norms, goal, seen)
        owners, counts = np.unique(found[0], return_counts=True)
        goal[owners[counts == k]] = found[2][np.cumsum(counts)[counts == k] - 1]

        least = goal - 10.0 ** -(self.digits - 1)
        left = np.nonzero((bounds * self.slack >= least[:, None]) & (bounds > 0) & ~done)
        more = [self._scores(*some, _ALIKE, weights, norms, goal, seen) for some in self._nearer(*left, weights, norms, least)]
        found = [np.concatenate(c) for c in zip(found, *more)]
        best = _best(found[0], self.place[found[1]], found[2], k)
        found = [f[best] for f in found]
        if self.include_zero:
            found = self._filled(found, n, n_seen, seen)
        user, item, score = found
        return pa.RecordBatch.from_arrays(
            [rows.column("user").take(pa.array(user)), self.items.take(pa.array(item)), pa.array(score)],
            names=["user_id", "item_id", "score"])

    def _bounds(self, unit: np.ndarray) -> np.ndarray:
        """By user and stretch of like items what any of these can score at most, but for rounding."""
        cols, most, begin, n = self.coarse
        by_term, out, first = np.ascontiguousarray(unit.T, np.float32), np.zeros((len(n), len(unit)), np.float32), 0
        ends, at_once = begin + n, max(1, _CHUNK // 4 // len(unit))
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(ends, begin[first] + at_once, side="right")))
            part = slice(begin[first], ends[last - 1])
            products = by_term[cols[part]]
            products *= most[part][:, None]
            np.add.reduceat(products, begin[first:last] - begin[first], axis=0, out=out[first:last])
            first = last
        return np.ascontiguousarray(out.T)

    def _dots(self, weights, user, begin, n, cols, vals) -> np.ndarray:
        """The user's weights times each stretch of entries."""
        at, entry = _spread(begin, n)
        vals = self._weights(entry) if vals is self.vals else vals[entry]
        return np.add.reduceat(vals * weights.ravel()[user[at] * self.n_terms + cols[entry]], np.cumsum(n) - n)

    def _nearer(self, users, stretches, weights, norms, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the given stretches of users the shorter ones whose own bound is enough, some at a time."""
        cols, most, begin, n = self.fine
        shorter = _LIKE // _ALIKE
        for s in range(0, len(users), _CHUNK // 16 // _LIKE):
            first = stretches[s : s + _CHUNK // 16 // _LIKE] * shorter
            at, stretch = _spread(first, np.minimum(shorter, len(n) - first))
            user = users[s : s + _CHUNK // 16 // _LIKE][at]
            near = self._dots(weights, user, begin[stretch], n[stretch], cols, most) * self.slack >= least[user] * norms[user]
            yield user[near], stretch[near]

    def _scores(self, users, stretches, like, weights, norms, goal, seen) -> list[np.ndarray]:
        """``user, item, score`` of unseen items in the given stretches of ``like`` items: each user's ``k`` best that are positive and reach the goal."""
        kept = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]]
        for s in range(0, len(users), _CHUNK // 128 // like):
            part = slice(s, s + _CHUNK // 128 // like)
            first = stretches[part] * like
            at, item = _spread(first, np.minimum(like, len(self.sizes) - first))
            user = users[part][at]
            self.scored += len(item)
            dots = self._dots(weights, user, self.starts[item], self.sizes[item], self.cols, self.vals)
            scale = self.norms[item] * norms[user]
            score = _quantize(np.divide(dots, scale, out=np.zeros(len(dots)), where=scale > 0), self.digits)
            good = np.flatnonzero((score > 0) & (score >= goal[user]))
            user, item, score = user[good], item[good], score[good]
            pair = user * len(self.items) + item
            if len(seen):
                unseen = seen[np.minimum(np.searchsorted(seen, pair), len(seen) - 1)] != pair
                user, item, score = user[unseen], item[unseen], score[unseen]
            kept.append([user, item, score])
        user, item, score = (np.concatenate(c) for c in zip(*kept))
        best = _best(user, self.place[item], score, self.k)
        return [user[best], item[best], score[best]]

    def _filled(self, found: list[np.ndarray], n: int, n_seen: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
        """Lists of fewer than ``k`` are filled up with the first unseen items in catalog order, which score 0."""
        short = np.flatnonzero(np.bincount(found[0], minlength=n) < self.k)
        added, width = [found], len(self.items)
        for u in short:
            # Fewer than k of these are found already, and no more than the seen ones are seen.
            first = self.by_place[: 2 * self.k + n_seen[u]]
            hidden = seen[np.searchsorted(seen, u * width) : np.searchsorted(seen, (u + 1) * width)] - u * width
            free = first[~np.isin(first, np.r_[found[1][found[0] == u], hidden])]
            free = free[: self.k - np.count_nonzero(found[0] == u)]
            added.append([np.full(len(free), u), free, np.zeros(len(free))])
        return [np.concatenate(c) for c in zip(*added)]


def nearest_items(
    k: int, include_zero: bool, digits: int, weight_digits: int, n_items: int, n_entries: int, profiles: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function over rows sorted by ``(part, nth)``: ``user_id, item_id, score`` of the ``k`` best unseen items of each user.

    Part 0 has the items in order of likeness, several a row, with their ``places`` in the catalog (-1: not to be scored) and the
    ``sizes`` of their vectors, whose weights are ``vals`` or, as whole numbers, ``ints``, and ``nth``, the first one's number. Part 1 has the
    users with, as ``places``, the numbers of seen items, and their profiles. With ``profiles`` these are formed here: ``times`` says how often
    each item was seen, ``matched`` how often any. There are at most ``n_items`` items of ``n_entries`` entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _LikeItems(k, include_zero, digits, weight_digits, n_items, n_entries, profiles)
        for batch in batches:
            for (part,), start, end in _runs(batch, ["part"]):
                rows = batch.slice(start, end - start)
                if part == 0:
                    items.add(rows)
                elif items.kept or items.items is not None:
                    yield from items.batches(rows)

    return run


def expand_rows(empty: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function from packed matrix rows of one bucket to one row a pair: ``user_id, other_id, sim, met``.

    The row of ``part`` 0 gives the bucket's users, those of ``part`` 1 are a user's. ``met`` is a bitmap, lowest bit
    first, over the bucket's places from 0; ``empty`` the value where it has no bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = None
        for batch in batches:
            columns = (batch.column(c) for c in ("part", "user_id", "others", "met", "pos", "sim"))
            for part, user, members, bitmap, pos, sim in zip(*columns, strict=True):
                if part.as_py() == 0:
                    others = members.values
                    continue
                met = np.zeros(len(others), bool)
                if bitmap.is_valid:
                    met = np.unpackbits(np.frombuffer(bitmap.as_buffer(), np.uint8), bitorder="little")[: len(others)].astype(bool)
                value, known = np.full(len(others), 0.0 if empty is None else empty), ~met if empty is not None else np.zeros(len(others), bool)
                at = pos.values.to_numpy()
                value[at], known[at] = sim.values.to_numpy(), True
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(user, len(others)), others, pa.array(value, mask=~known), pa.array(met)],
                    names=["user_id", "other_id", "sim", "met"])

    return run


def _ngram_keys(
    tokens: pa.Array, words: pa.Array, low: int, high: int, bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each n-gram of ``low..high`` of the given words that starts in the first ``WORDS_PER_ROW`` of a row.

    A word's number is its place from 1 on, the first word's in the lowest bits.
    """
    length = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = np.repeat(np.arange(len(length)), length)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    left = np.repeat(length, length) - nth
    at = np.flatnonzero((nth < WORDS_PER_ROW) & (codes > 0))
    key, rows, keys = codes[at], [], []
    for n in range(1, high + 1):
        if n > 1:
            longer = left[at] >= n
            at, key = at[longer], key[longer]
            following = codes[at + n - 1]
            known = following > 0
            at, key = at[known], key[known] | following[known] << bits * (n - 1)
        if n >= low:
            rows.append(row[at])
            keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows of up to ``WORDS_PER_ROW`` words in parts of at most about ``_CHUNK`` words."""
    for batch in batches:
        for s in range(0, batch.num_rows, _CHUNK // WORDS_PER_ROW):
            yield batch.slice(s, _CHUNK // WORDS_PER_ROW)


def ngram_totals(
    known: list[str], low: int, high: int, bits: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function from ``tokens`` to ``key, n``: how often n-grams of known words occur, as numbers of ``bits`` a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(known, pa.string())
        for part in _parts(batches):
            _, keys = _ngram_keys(part.column("tokens"), words, low, high, bits)
            key, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def listed_ngrams(terms: list[str], low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function from ``item_id, tokens`` to ``item_id, place, n``: how often a row has each listed term, by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [term.split(" ") for term in terms]
        code = {word: i for i, word in enumerate(sorted({word for term in split for word in term}), 1)}
        bits = len(code).bit_length()
        listed = [(sum(code[word] << bits * i for i, word in enumerate(term)), place) for place, term in enumerate(split) if len(term) <= high]
        if not listed:
            return
        listed_keys, places = (np.array(c, dtype=np.int64) for c in zip(*sorted(listed)))
        words = pa.array(list(code), pa.string())
        for part in _parts(batches):
            row, key = _ngram_keys(part.column("tokens"), words, low, high, bits)
            at = np.minimum(np.searchsorted(listed_keys, key), len(listed_keys) - 1)
            found = listed_keys[at] == key
            pair, n = np.unique(row[found] * len(terms) + places[at[found]], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(pair // len(terms))), pa.array((pair % len(terms)).astype(np.int32)),
                 pa.array(n, pa.int64())], names=["item_id", "place", "n"])

    return run
