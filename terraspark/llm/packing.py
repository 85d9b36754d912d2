"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Pieces go in order of falling length to the open bin with the least room that
holds them (best fit).  If none does, a bin is opened, and when all pieces are
placed every bin shrinks to the shortest permitted length that holds its contents.

A sequence of n tokens costs ``overhead + n + n * n / attention``: some fixed work,
work for each token, and work for each pair of tokens.  So a long bin wastes less
but its tokens cost more, and which length is best for a piece depends on all the
others.  The lengths are therefore chosen jointly: pieces fall into classes by the
shortest length that holds them, each class has the length at which it opens bins,
and the choice for all classes together is improved one class at a time, each time
by the whole packing's cost, until no change of one class makes it cheaper.  The
search begins at the best of the choices "no bin longer than needed or than c", so
the result is never dearer than any of those.

Texts longer than the longest length are cut into pieces of that length and a
rest.  Rows are dealt by hash into groups of a bounded number of pieces, each
packed by one task; a full-length piece fills its bin alone and needs no search.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from . import tables as T

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin beyond its tokens, in tokens (the fixed work for each sequence).
OVERHEAD = 16
#: Tokens of a sequence at which the work for its pairs equals the work for its tokens.
ATTENTION = 16_384


def cost(length: int | np.ndarray, overhead: float = OVERHEAD, attention: float | None = ATTENTION):
    """Cost of a sequence, in tokens; without ``attention`` pairs cost nothing."""
    return overhead + length + (length * length / attention if attention else 0)


def _place(sizes: list[int], opens: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Best fit of falling ``sizes``: bin and offset of each, and each bin's opened length and contents.

    ``opens[i]`` is the length at which a bin is opened for size ``i``.
    """
    bins, offsets, opened, used = [], [], [], []
    # Open bins by room, and the rooms that have any as bits of one number.
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for n in sizes:
        least = n or 1
        above = rooms >> least
        if above:
            room = least + (above & -above).bit_length() - 1
            waiting = by_room[room]
            b = waiting.pop()
            if not waiting:
                rooms ^= 1 << room
        else:
            room, b = opens[n], len(opened)
            opened.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if left := room - n:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, opened, used


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float | None = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the final length of each bin; a size must not exceed the longest length."""
    lengths = sorted(lengths)
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return sizes, sizes, sizes
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    permitted, shortest = np.asarray(lengths), np.searchsorted(lengths, np.arange(lengths[-1] + 1))
    present = np.unique(shortest[sizes])[::-1].tolist()
    tried: dict[tuple, tuple[float, tuple]] = {}

    def packed(choice: list[int]) -> tuple[float, tuple]:
        key = tuple(choice)
        if key not in tried:
            placed = _place(falling, permitted[np.asarray(choice)[shortest]].tolist())
            tried[key] = float(cost(permitted[np.searchsorted(lengths, placed[3])], overhead, attention).sum()), key
        return tried[key]

    # No class opens a bin longer than needed or than the c-th length.
    best = min(packed([max(c, k) for k in range(len(lengths))]) for c in range(len(lengths)))
    better = len(lengths) > 1
    while better:
        better = False
        for k in present:
            for c in range(k, len(lengths)):
                choice = list(best[1])
                choice[k] = c
                if (found := packed(choice))[0] < best[0]:
                    best, better = found, True
    bins, offsets, _, used = _place(falling, permitted[np.asarray(best[1])[shortest]].tolist())
    which, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    which[order], at[order] = bins, offsets
    return which, at, permitted[np.searchsorted(lengths, used)].astype(np.int64)


_OUT = "doc_id long, piece int, first_word long, n_words long, bin_id long, bin_offset long, bin_length int, bin_words long"


def pack(documents: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, per_group: int = 20_000, text: str = "text", attention: float | None = ATTENTION) -> DataFrame:
    """One row a piece: its words in the text, its bin, its offset in the bin, the bin's length and contents.

    Lengths are counted in words.  Null and empty texts are a single piece of 0 words
    that shares a bin; repeated rows are packed as often as they occur; a text of any
    length is cut into pieces without losing a word; a null doc_id stays null.  Other
    columns, whatever their names, are not read.  An empty table gives an empty table.
    """
    lengths = tuple(sorted(int(x) for x in lengths))
    top = lengths[-1]
    sizes = T.written(mixing.with_word_count(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text), text, "size", keep_text=False), "pack-sizes")
    n = sizes.agg(F.count("*"), F.coalesce(F.sum(F.floor(F.col("size") / top)), F.lit(0))).first()
    groups = T.parts_for(n[0] + n[1], per_group)

    def pack_group(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks()
        # A null id sorts before all others.
        order = np.lexsort((table["salt"].to_numpy(), table["size"].to_numpy(), ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)))
        doc, size = ids.take(pa.array(order)), table["size"].to_numpy()[order]
        group = table["group"][0].as_py()
        pieces = np.maximum(-(-size // top), 1)
        row = np.repeat(np.arange(len(doc)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        words = np.minimum(size[row] - piece * top, top)
        full = words == top
        bins, offsets, final = best_fit(words[~full], lengths, overhead, attention)
        which, offset = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        which[~full], offset[~full] = bins, offsets
        which[full] = len(final) + np.arange(full.sum())
        final = np.concatenate([final, np.full(full.sum(), top)])
        contents = np.bincount(which, weights=words, minlength=len(final)).astype(np.int64)
        return pa.table({
            "doc_id": doc.take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "first_word": pa.array(piece * top, pa.int64()),
            "n_words": pa.array(words, pa.int64()), "bin_id": pa.array((group << 32) + which, pa.int64()), "bin_offset": pa.array(offset, pa.int64()),
            "bin_length": pa.array(final[which], pa.int32()), "bin_words": pa.array(contents[which], pa.int64()),
        })

    dealt = sizes.withColumn("salt", F.xxhash64("doc_id", "size"))
    # Repeats of one row are dealt apart, so that no group takes them all.
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack_group, _OUT)
