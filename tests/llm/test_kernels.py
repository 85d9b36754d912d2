"""The vectorised kernels against plain Python on arbitrary texts."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from terraspark.llm import bitsliced, near_dedup, packing, tables
from terraspark.llm import kernels as K

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.none() | st.text(alphabet=st.sampled_from("aAbBzÉß漢 \t\n\x0b\x0c\r\x1c\x85\xa0,."), max_size=60), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 4))
def test_words_and_windows(rows, n):
    column = pa.array(rows, pa.string())
    raw, offsets = K.texts_of(column)
    starts, ends, first = K.word_bounds(raw, offsets)
    want = [WORD.findall((t or "").encode()) for t in rows]
    got = [[raw[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == want
    assert K.word_counts(column).tolist() == [len(w) for w in want]
    words = K.word_hashes(raw, starts, ends, lower=True)
    at, begin = K.window_starts(first, n)
    hashes = K.window_hashes(words, at, n)
    flat = [tuple(x.lower() for x in w[i : i + n]) for w in want for i in range(len(w) - n + 1)]
    assert len(hashes) == len(flat) and begin[-1] == len(flat)
    # Equal windows have equal hashes and different ones different.
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    sets, sizes = K.shingle_sets(raw, offsets, n)
    for i, w in enumerate(want):
        w = [x.lower() for x in w]
        distinct = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()
        mine = sets[sizes[i] : sizes[i + 1]]
        assert len(mine) == len(distinct) and (np.diff(mine.astype(object)) > 0).all()


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 50))
def test_chunks_cover_all_rows(rows, size):
    _, offsets = K.texts_of(pa.array(rows, pa.string()))
    assert [i for a, b in K.chunked(offsets, size) for i in range(a, b)] == list(range(len(rows)))


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 4), st.integers(1, 40), st.integers(2, 30))
def test_pieces_change_nothing(rows, n, size, stretch):
    raw, offsets = K.texts_of(pa.array(rows, pa.string()))
    starts, ends, first = K.word_bounds(raw, offsets)
    whole = [K.word_hashes(raw, starts, ends, lower=True, second=x) for x in (False, True)]
    at, _ = K.window_starts(first, n)
    windows = [K.window_hashes(whole[0], at, n, second=x) for x in (False, True)]
    sets = [K.shingle_sets(raw[a:b], np.array([0, b - a]), n)[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    saved = K.CHUNK_BYTES, K.STRETCH
    try:
        K.CHUNK_BYTES, K.STRETCH = size, stretch
        assert all((K.word_hashes(raw, starts, ends, lower=True, second=x) == whole[x]).all() for x in (0, 1))
        assert all((K.window_hashes(whole[0], at, n, second=x) == windows[x]).all() for x in (0, 1))
        long = K.pieces.__defaults__
        K.pieces.__defaults__ = (size,)
        try:
            assert [i for a, b, low, high in K.pieces(raw, offsets) for i in range(low, high)] == list(range(len(raw)))
            for s, a, b in zip(sets, offsets[:-1], offsets[1:], strict=True):
                assert K.shingle_sets(raw[a:b], np.array([0, b - a]), n)[0].tolist() == s.tolist()
        finally:
            K.pieces.__defaults__ = long
    finally:
        K.CHUNK_BYTES, K.STRETCH = saved


def test_slices_of_columns():
    column = pa.array(["one two", None, "three", "a b c"]).slice(1, 3)
    assert K.word_counts(column).tolist() == [0, 1, 3]
    assert K.word_counts(column.cast(pa.large_string())).tolist() == [0, 1, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(1, 50))
def test_parts_are_ranges(values, parts):
    hashes = np.unique(np.array(values, np.uint64))
    pieces = tables.by_part(hashes, parts)
    assert [i for _, a, b in pieces for i in range(a, b)] == list(range(len(hashes)))
    assert [p for p, _, _ in pieces] == sorted({p for p, _, _ in pieces})


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.75, 0.9):
        n = 2000
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        (v, tokens), (w, others) = (near_dedup.signature(np.sort(s)) for s in (x[:n], x[n - both :]))
        a, b = near_dedup._unpacked(pa.chunked_array([[near_dedup._packed(v), near_dedup._packed(w)]]))
        assert abs(near_dedup._estimate((a == b).mean()) - j) < 0.12
        # A chosen token is shared exactly where the minimum is.
        assert ((tokens == others) == (v == w)[: near_dedup.PATHS]).all() and set(tokens) <= set(x[:n])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 6), st.integers(0, 2**31), st.integers(1, 9))
def test_bit_sliced_scores(n, dims, seed, k):
    rng = np.random.default_rng(seed)
    vectors, query = rng.integers(-200, 200, (n, dims)), rng.integers(-200, 200, dims)
    ids = rng.permutation(n) * 3
    index = bitsliced.Index(ids, vectors)
    rows, scores = index.top(query, k, int(ids[0]))
    want = sorted(((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[0]))[:k]
    assert sorted((-int(s), int(index.ids[r])) for r, s in zip(rows, scores, strict=True)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_best_fit_bins_hold_their_pieces(sizes):
    bins, offsets, final = packing.best_fit(sizes, (16, 32, 64))
    used = np.bincount(bins, weights=sizes, minlength=len(final)) if sizes else np.zeros(0)
    assert all(u <= f for u, f in zip(used, final, strict=True))
    assert all(f == min(x for x in (16, 32, 64) if x >= u) for u, f in zip(used, final, strict=True))
