"""Substring dedup with difference-cover anchors.

Two equal runs of 20 words start anywhere in two texts.  Anchors are windows of 8
words that start at word positions whose remainder modulo 13 lies in the perfect
difference cover {0, 1, 3, 9}: for any two starts some shift below 13 brings both
to cover positions, so the two runs share an aligned anchor of 8 words
(12 + 8 = 20).  Hence only 4 of 13 windows are hashed for the search:

1. Blocks of documents send their distinct anchor hashes, cut to 5 bytes and
   packed by hash range, to parts; a part answers each block with one bit a hash:
   does another block have it?  A hash that is in a third of all documents reaches
   its part once from each block, never once from each document.
2. A window of 20 words is a candidate if one of its four anchors repeats.  The
   anchors are extended: blocks send each candidate's hash of 96 bits, from two
   independent polynomials over two independent hashes of each word, with its first
   place in the block, and the part answers where the first place overall is.
3. Each block removes the words of all windows that are not the first.

The anchor pass only selects candidates: a chance collision of cut hashes costs
time, not results.  Windows are equal if their 96 bits are: among 10**12 candidates
6e-6 chance collisions are expected.  Parts grow with the input up to two million
hashes, so that a block's message to a part does not shrink before that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import tables as T

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Words:
    """Words of a block, its anchors and its windows."""

    def __init__(self, batch: pa.RecordBatch, text: str, key: str):
        self.raw, self.offsets = K.texts_of(batch.column(batch.schema.get_field_index(text)))
        self.starts, self.ends, self.first = K.word_bounds(self.raw, self.offsets)
        self.words = K.word_hashes(self.raw, self.starts, self.ends, lower=False)
        ids = batch.column(batch.schema.get_field_index(key)).cast(pa.int64())
        # A null id sorts before all others.
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)

    def second(self, windows: np.ndarray) -> np.ndarray:
        """32 further bits of each window, from hashes of its words that are independent of the first."""
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, windows, 1)
        np.add.at(marks, windows + WINDOW, -1)
        inside = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        words = np.zeros(len(self.words), K.U64)
        words[inside] = K.word_hashes(self.raw, self.starts[inside], self.ends[inside], lower=False, second=True)
        return (K.window_hashes(words, windows, WINDOW, second=True) >> np.uint64(32)).astype(np.uint32)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Row of each word index."""
        return np.searchsorted(self.first, at, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word index and hash of each anchor, in order of the index."""
        at, _ = K.window_starts(self.first, ANCHOR)
        row = self.place(at)
        at = at[_IN_COVER[(at - self.first[row]) % PERIOD]]
        return at, K.window_hashes(self.words, at, ANCHOR)

    def candidates(self, at: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor within their first 13 positions."""
        hit = np.zeros(len(self.words) + 1, np.int32)
        hit[at[repeated] + 1] = 1
        sums = np.cumsum(hit)
        starts, _ = K.window_starts(self.first, WINDOW)
        return starts[sums[starts + PERIOD] > sums[starts]]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the place of each input in them, and their counts."""
    return np.unique(hashes, return_inverse=True, return_counts=True)[:3] if len(hashes) else (hashes, np.empty(0, np.int64), np.empty(0, np.int64))


def _cut(hashes: np.ndarray) -> bytes:
    """The upper 5 bytes of what the part does not tell, that is bits 0-39 of a hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _uncut(blob: bytes) -> np.ndarray:
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


def _in_sorted(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x


def _repeated(parts_table: pa.Table) -> pa.Table:
    """Answers to the blocks of one part: which of their hashes another block has too."""
    at = parts_table.column("block").to_pylist()
    each = [_uncut(x.as_buffer()) for x in parts_table.column("blob").combine_chunks()]
    values = np.sort(np.concatenate(each))
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    part = parts_table.column("part")[0].as_py()
    rows = [(b, np.packbits(hit).tobytes()) for b, x in zip(at, each, strict=True) if (hit := _in_sorted(x, twice)).any()]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "kind": pa.array([1] * len(rows), pa.int32()), "bits": pa.array([r[1] for r in rows], pa.binary())})


def _changes(hashes: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a sorted pair of hashes is another than the one before."""
    out = np.ones(len(hashes), dtype=bool)
    out[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
    return out


_PLACES = pa.schema([("hash", pa.uint64()), ("second", pa.uint32()), ("doc", pa.int64()), ("start", pa.int64())])


def _firsts(parts_table: pa.Table) -> pa.Table:
    """Answers to the blocks of one part: for which hashes they hold the first place of all."""
    at = parts_table.column("block").to_pylist()
    each = [T.unpack(x.as_buffer()) for x in parts_table.column("blob").combine_chunks()]
    sizes = np.cumsum([0, *(x.num_rows for x in each)])
    hashes, second, doc, start = (np.concatenate([x.column(i).to_numpy() for x in each]) for i in range(4))
    order = np.lexsort((start, doc, second, hashes))
    group = np.cumsum(_changes(hashes[order], second[order])) - 1
    lead = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
    first = np.empty(len(order), dtype=bool)
    # Equal places (a repeated row) are all first.
    first[order] = (doc[order] == doc[lead][group]) & (start[order] == start[lead][group])
    part = parts_table.column("part")[0].as_py()
    rows = [(b, np.packbits(first[sizes[i] : sizes[i + 1]]).tobytes()) for i, b in enumerate(at)]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "kind": pa.array([2] * len(rows), pa.int32()), "bits": pa.array([r[1] for r in rows], pa.binary())})


_REPLY = "block long, part int, kind int, bits binary"
_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


def _in_block(w: _Words, at: np.ndarray):
    """Distinct hashes (both parts) of windows with their first place in the block, and per window its hash's index."""
    hashes, second = K.window_hashes(w.words, at, WINDOW), w.second(at)
    row = w.place(at)
    doc, start = w.ids[row], at - w.first[row]
    order = np.lexsort((start, doc, second, hashes))
    new = _changes(hashes[order], second[order])
    lead = order[new]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return hashes[lead], second[lead], doc[lead], start[lead], which, doc, start


def remove_repeats(
    documents: DataFrame, key: str = "doc_id", text: str = "text", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, then_schema: str = ""
) -> DataFrame:
    """All columns of ``documents`` with ``n_words``, ``n_removed`` and ``kept_text``.

    Words of any 20-word window whose sequence also starts earlier (smaller key, or
    same key and earlier start) are removed; windows are judged on the input.
    ``kept_text`` joins the kept words by one space; it is null where nothing was
    removed, so that such a text stays as it was.

    Null and empty texts have no words; texts under 20 words are never touched; a
    repeated row (same key, same text) has the same places as its twin and both are
    kept.  A null key counts as smaller than all.  Columns of the same names as the
    three results are replaced.  An empty table gives an empty table.  ``then`` turns
    each result batch into one of ``then_schema`` where it is made.
    """
    documents = documents.drop("n_words", "n_removed", "kept_text")
    stored = T.blocks(documents, text)
    total = stored.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # About four anchors in 13 words of six bytes.
    entries = total // 20
    parts = T.parts_for(entries, min(2_000_000, max(400_000, entries // 20_000)), 8)

    def send_anchors(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, hashes = _Words(T.unpack(blob.as_buffer()), text, key).anchors()
                seen = _distinct(hashes)[0]
                yield _sent([(p, block, _cut(seen[a:b])) for p, a, b in T.by_part(seen, parts)])

    sent = stored.select("block", "blob").mapInArrow(send_anchors, "part int, block long, blob binary")
    replies = T.written(sent.groupBy("part").applyInArrow(_repeated, _REPLY), "anchors")

    def looked_up(batch: pa.RecordBatch, answers: list | None):
        w = _Words(batch, text, key)
        at, hashes = w.anchors()
        seen, which, counts = _distinct(hashes)
        repeated = (T.bits_of(answers, 1, seen, parts) | (counts > 1))[which] if len(at) else np.empty(0, bool)
        windows = w.candidates(at, repeated)
        return w, windows, _in_block(w, windows)

    def send_windows(batches):
        for batch in batches:
            for block, blob, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                _, _, (hashes, second, doc, start, *_) = looked_up(T.unpack(blob.as_buffer()), answers)
                packed = pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes, second, doc, start)], schema=_PLACES)
                yield _sent([(p, block, T.pack(packed.slice(a, b - a))) for p, a, b in T.by_part(hashes, parts)])

    with_anchors = stored.select("block", "blob").join(T.replies_by_block(replies), "block", "left")
    sent = with_anchors.mapInArrow(send_windows, "part int, block long, blob binary")
    firsts = T.written(sent.groupBy("part").applyInArrow(_firsts, _REPLY), "windows")

    fields = documents.schema
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long", "n_removed long", "kept_text string"])

    def remove(batches):
        for batch in batches:
            for blob, answers in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows = T.unpack(blob.as_buffer())
                w, windows, (hashes, _, _, _, which, doc, start) = looked_up(rows, answers)
                is_first = T.bits_of(answers, 2, hashes, parts)
                # The window at the first place is the block's first one, if that is the first of all.
                lead_doc, lead_start = _leads(hashes, which, doc, start)
                gone = ~(is_first[which] & (doc == lead_doc[which]) & (start == lead_start[which])) if len(windows) else np.empty(0, bool)
                marks = np.zeros(len(w.words) + 1, np.int64)
                np.add.at(marks, windows[gone], 1)
                np.add.at(marks, windows[gone] + WINDOW, -1)
                removed = np.cumsum(marks[:-1]) > 0
                n_words = np.diff(w.first)
                sums = np.r_[0, np.cumsum(removed)]
                n_removed = sums[w.first[1:]] - sums[w.first[:-1]]
                kept = [_join(w, i, removed) if n_removed[i] else None for i in range(rows.num_rows)]
                out = pa.RecordBatch.from_arrays([*rows.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*rows.schema.names, "n_words", "n_removed", "kept_text"])
                yield then(out) if then else out

    both = T.replies_by_block(replies.unionByName(firsts))
    return stored.select("block", "blob").join(both, "block", "left").mapInArrow(remove, then_schema or out_schema)


def _leads(hashes, which, doc, start):
    """First place in the block of each distinct hash."""
    lead_doc, lead_start = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    order = np.lexsort((start, doc, which))[::-1]
    lead_doc[which[order]], lead_start[which[order]] = doc[order], start[order]
    return lead_doc, lead_start


def _join(w: _Words, row: int, removed: np.ndarray) -> str:
    a, b = w.first[row], w.first[row + 1]
    keep = a + np.flatnonzero(~removed[a:b])
    raw = w.raw
    return b" ".join(raw[s:e].tobytes() for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)).decode("utf-8", "replace")
