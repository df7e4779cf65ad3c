"""Words and word windows of whole Arrow batches as NumPy arrays; runs inside tasks.

A batch of texts is one byte array: words are found by a table of byte classes, hashed by prefix sums of
a polynomial modulo 2**64 and mixed, so no Python object is made for a word. Words cannot span rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPAN = 2 << 20  # a word longer than this is hashed by itself
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def blank_separated() -> np.ndarray:
    """Byte table of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Byte table of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, for text with A-Z lower-cased."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_VALUES = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_BYTES, _WINDOWS = _Powers(_BASE), _Powers(_WINDOW_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """``hashes``, ``starts``, ``ends`` (bytes) by word; row ``r`` has words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def limits(self) -> np.ndarray:
        """By word, the index after the last word of its row."""
        return np.repeat(self.first[1:], np.diff(self.first))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``limit`` text bytes; a longer text is a run of its own."""
    sizes = np.diff(_offsets(batch.column(text)))
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def split_words(texts: pa.Array, table: np.ndarray, lower: bool = False) -> Words:
    """All words of all rows; null rows have none."""
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = _offsets(texts)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(bounds))
    opens[bounds[:-1][full]] = inside[bounds[:-1][full]]
    closes[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, bounds)
    return Words(data, _hash_spans(data, starts, ends), starts, ends, first)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        piece = data[base : ends[to - 1]]
        if len(piece) > _SPAN:
            out[at] = int.from_bytes(hashlib.blake2b(piece.tobytes(), digest_size=8).digest(), "little")
        else:
            up, down = _BYTES.upto(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUES[piece] * up[: len(piece)], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix((sums[e] - sums[s]) * down[s])
        at = to
    return out


def windows(words: Words, size: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of all windows of ``size`` consecutive words of one row; ``base`` varies the hash."""
    hashes = mix(words.hashes ^ np.uint64(base)) if base else words.hashes
    up, down = _WINDOWS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    at = np.flatnonzero(np.arange(len(hashes)) + size <= words.limits())
    return at, mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size))


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """By row, the sorted distinct hashes of its windows; a shorter row is one window of all its words."""
    at, hashes = windows(words, size)
    cuts = np.searchsorted(at, words.first)
    counts = np.diff(words.first)
    for row, count in enumerate(counts):
        if count >= size:
            yield np.unique(hashes[cuts[row] : cuts[row + 1]])
        elif count:
            own = words.hashes[words.first[row] : words.first[row + 1]]
            up, _ = _WINDOWS.upto(count)
            yield mix(np.array([np.sum(own * up[:count], dtype=np.uint64) + np.uint64(count)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
