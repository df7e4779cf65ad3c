"""Words, windows and sketches against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import LOWER, alnum_words, words

from tastemesh.llm import words as W
from tastemesh.llm.sketch import is_repeated, repeated_bits

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAb ,.\n\t\x0b\x1f9éß漢"), max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_of_rows(texts, skipped):
    column = pa.array(texts, pa.string())[skipped:]
    for table, lower, plain in ((W.blank_separated(), False, words), (W.alphanumeric(), True, alnum_words)):
        found = W.split_words(column, table, lower)
        tokens = [bytes(found.data[s:e]).decode() for s, e in zip(found.starts, found.ends, strict=True)]
        rows = [tokens[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        assert rows == [plain(t) for t in texts[skipped:]]
        known = {}
        for token, h in zip(tokens, found.hashes.tolist(), strict=True):
            assert known.setdefault(token, h) == h
        assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows_and_sets(texts, size):
    found = W.split_words(pa.array(texts, pa.string()), W.blank_separated(), True)
    rows = [words((t or "").translate(LOWER)) for t in texts]
    at, hashes = W.windows(found, size)
    want = [tuple(r[i : i + size]) for r in rows for i in range(len(r) - size + 1)]
    assert len(at) == len(want)
    by_hash = {}
    for w, h in zip(want, hashes.tolist(), strict=True):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
    sizes = [len(s) for s in W.shingle_sets(found, size)]
    assert sizes == [len({tuple(r[i : i + size]) for i in range(max(1, len(r) - size + 1))}) if r else 0 for r in rows]


def test_long_words_and_chunks(monkeypatch):
    texts = ["ab " * 50, "c" * 200, "ab c", "c" * 200 + " ab", None]
    whole = W.split_words(pa.array(texts), W.blank_separated())
    monkeypatch.setattr(W, "_SPAN", 16)
    pieces = W.split_words(pa.array(texts), W.blank_separated())
    short = whole.ends - whole.starts <= 16
    assert (whole.hashes[short] == pieces.hashes[short]).all()
    assert len(set(pieces.hashes[~short].tolist())) == 1
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [t for c in W.chunks(batch, limit=150) for t in c.column(0).to_pylist()] == texts
    assert max(c.num_rows for c in W.chunks(batch, limit=150)) < 5


def test_sketch_loses_no_repeat(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**62, 3000, dtype=np.uint64) * np.uint64(4)
    keys = np.concatenate([keys, keys[:500], keys[:100]])
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long").repartition(7)
    bits = 20
    bitmap = repeated_bits(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), bits).value
    marked = is_repeated(bitmap, keys, bits)
    assert marked[:500].all() and marked[500:3000].mean() < 0.02
    empty = repeated_bits(df.where("k = 1"), lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), bits).value
    assert not empty.any()
