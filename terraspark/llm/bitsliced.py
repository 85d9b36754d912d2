"""Exact top-k inner products on a bit-sliced index.

Vectors are dealt into blocks.  In a block each attribute, less its minimum, is
stored as bit slices: bitmap i has bit i of the attribute for every row.  A query's
score is a sum of shifted slices, one for each set bit of each weight; a negative
weight takes the complemented slices and a constant.  All slices of one position
are added at once by carry-save adders, so a score of all rows is about fifteen
bitmaps.  The best rows come from the most significant bitmap downward; rows that
tie at the boundary have equal scores in every slice and are settled by id.

Vectors with a component beyond ``LARGEST`` are kept as text and their scores, and
those of all rows against them, are sums of Python's whole numbers: slower, and exact
at any size.  A score among the best that no long holds is an error, not a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T

SCALE = 64
BLOCK_ROWS = 16_384
QUERY_GROUP = 512
#: Beyond this a sum of products may not fit 64 bits: such vectors take the exact way.
LARGEST = 1 << 27
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, q, wide)``: floor(64 * x) of each usable vector, as packed 64-bit integers or, where one is too large for them, as text."""

    def fn(batches):
        for b in batches:
            ids, rows = b.column(0), b.column(1)
            out_ids, out, texts = [], [], []
            offsets = rows.offsets.to_numpy()
            values = rows.values
            nulls = np.asarray(values.is_null())
            x = np.asarray(values.fill_null(0)).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.floor(SCALE * x)
            bad = nulls | ~np.isfinite(x)
            large = ~bad & ~(np.abs(q) <= LARGEST)
            q = np.where(bad | large, 0, q).astype("<i8")
            wrong, wide = (np.concatenate([[0], np.cumsum(m)]) for m in (bad, large))
            there = np.asarray(rows.is_valid()) & np.asarray(ids.is_valid())
            for i, v in enumerate(ids.to_pylist()):
                a, e = offsets[i], offsets[i + 1]
                if there[i] and wrong[a] == wrong[e]:
                    out_ids.append(v)
                    exact = wide[a] != wide[e]
                    out.append(None if exact else q[a:e].tobytes())
                    # A power of two times a double is exact; only the product itself may be out of a double's range.
                    texts.append(" ".join(str(int(SCALE * f // 1) if abs(f) < 1e300 else SCALE * int(f)) for f in x[a:e].tolist()) if exact else None)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary()), pa.array(texts, pa.string())], names=["id", "q", "wide"])

    return embeddings.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(fn, "id long, q binary, wide string")


def _whole(q: bytes | None, wide: str | None) -> list[int]:
    """A vector as Python's whole numbers."""
    return [int(v) for v in wide.split()] if q is None else np.frombuffer(q, "<i8").tolist()


def _dot(x: list[int], y: list[int]) -> int:
    return sum(a * b for a, b in zip(x, y, strict=False))


def _matrix(blobs: list[bytes], width: int | None = None) -> np.ndarray:
    width = max((len(x) // 8 for x in blobs), default=0) if width is None else width
    out = np.zeros((len(blobs), width), np.int64)
    for i, x in enumerate(blobs):
        v = np.frombuffer(x, "<i8")[:width]
        out[i, : len(v)] = v
    return out


class Index:
    """Bit slices of one block of vectors; rows in order of id and then of their number."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray | None = None):
        numbers = ids if numbers is None else numbers
        order = np.lexsort((numbers, ids))
        self.ids, self.numbers, vectors = ids[order], numbers[order], vectors[order]
        self.n, self.dims = vectors.shape
        self.words = -(-max(self.n, 1) // 64)
        self.low = vectors.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        shifted = (vectors - self.low).astype(np.uint64)
        top = shifted.max(axis=0) if self.n else np.zeros(self.dims, np.uint64)
        self.bits = np.array([int(t).bit_length() for t in top], np.int64)
        slices = [self._bitmap((shifted[:, d] >> np.uint64(i)) & np.uint64(1)) for d in range(self.dims) for i in range(self.bits[d])]
        plain = np.array(slices, np.uint64).reshape(-1, self.words)
        self.begin = np.concatenate([[0], np.cumsum(self.bits)])
        self.full = self._bitmap(np.ones(self.n, np.uint64))
        # Complements follow the plain slices.
        self.slices = np.concatenate([plain, ~plain & self.full])

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, np.uint8)
        some = np.packbits(bits.astype(bool), bitorder="little")
        packed[: len(some)] = some
        return packed.view("<u8")

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of all rows' scores from the lowest bit up, and the constant to add."""
        q = np.zeros(self.dims, np.int64)
        q[: min(len(query), self.dims)] = query[: self.dims]
        down = q < 0
        # For a weight below zero: -w * x = w * (M - x) - w * M with M all ones.
        constant = sum(int(w) * int(m) for w, m in zip(q, self.low, strict=True)) + sum(int(q[d]) * ((1 << int(self.bits[d])) - 1) for d in np.flatnonzero(down))
        weight = np.abs(q)
        slots: dict[int, list[int]] = {}
        half = self.begin[-1]
        for d in np.flatnonzero((weight > 0) & (self.bits > 0)).tolist():
            base, w, shift = int(self.begin[d] + half * down[d]), int(weight[d]), 0
            while w:
                if w & 1:
                    for i in range(int(self.bits[d])):
                        slots.setdefault(shift + i, []).append(base + i)
                w >>= 1
                shift += 1
        out, carried, p = [], np.empty((0, self.words), np.uint64), 0
        while p <= max(slots, default=-1) or len(carried):
            stack = np.concatenate([self.slices[slots[p]], carried]) if p in slots else carried
            carries = []
            while len(stack) > 2:
                k = len(stack) // 3
                a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                u = a ^ b
                carries.append((a & b) | (u & c))
                stack = np.concatenate([u ^ c, stack[3 * k :]])
            if len(stack) == 2:
                carries.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.empty((0, self.words), np.uint64)
            p += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best, ties to the smaller id; ``skip`` is the number of a row left out."""
        slices, constant = self.scores(query)
        tied = self.full.copy()
        if skip is not None:
            for at in np.flatnonzero(self.numbers == skip).tolist():
                tied[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sure = np.zeros(self.words, np.uint64)
        n_sure = 0
        for s in reversed(slices):
            high = tied & s
            n = n_sure + int(np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                sure, n_sure = sure | high, n
                tied = tied & ~s
                if n == k:
                    break
        rows = self._rows(sure)
        if n_sure < k:
            rows = np.concatenate([rows, self._rows(tied)[: k - n_sure]])
        values = np.full(len(rows), constant, np.int64)
        for p, s in enumerate(slices):
            values += ((s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p
        return rows, values

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=self.n, bitorder="little"))


def top_k(embeddings: DataFrame, queries_every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other vectors for each query.

    Queries are the rows whose key is divisible by ``queries_every``.  Null keys, null
    vectors and vectors with a null or non-finite component take no part.  Rows of equal
    key and equal vector count once; different vectors under one key are rows of their
    own, as queries and as candidates (a query leaves out itself alone).  Ties go to the
    smaller key.  A shorter vector counts as padded with zeros; an empty vector scores 0
    everywhere.  A score in the result that a long cannot hold is an error.  Other
    columns, whatever their names, are not read; an empty table gives an empty table.
    """
    rows = T.written(quantised(embeddings, key, vector).distinct().withColumn("number", F.monotonically_increasing_id()), "vectors")
    query = F.col("id") % queries_every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(query)).first()
    n_blocks, n_groups = T.parts_for(n, BLOCK_ROWS), T.parts_for(n_queries, QUERY_GROUP)
    deal = lambda parts, salt: F.pmod(F.xxhash64("number", F.lit(salt)), F.lit(parts))
    row = F.struct("id", "number", "q", "wide")
    # Each pair of a block and a group of queries is one task's work; both are bounded.
    packed = rows.withColumn("block", deal(n_blocks, 1)).groupBy("block").agg(F.collect_list(row).alias("rows"))
    groups = rows.where(query).withColumn("group", deal(n_groups, 2)).groupBy("group").agg(F.collect_list(row).alias("queries"))
    left = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<bigint>")))
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                # Without to_pylist: a block is thousands of rows.
                block, wanted = batch.column("rows")[i].values, batch.column("queries")[i].values
                plain = block.filter(block.field("wide").is_null())
                exact = block.filter(block.field("wide").is_valid()).to_pylist()
                exact = [(r["id"], r["number"], _whole(None, r["wide"])) for r in exact]
                index = Index(plain.field("id").to_numpy(), _matrix(plain.field("q").to_pylist()), plain.field("number").to_numpy())
                every = None
                out = [[], [], [], [], []]
                for r in wanted.to_pylist():
                    if r["wide"] is None:
                        at, scores = index.top(np.frombuffer(r["q"], "<i8"), k, r["number"])
                        found = list(zip(scores.tolist(), index.ids[at].tolist(), strict=True))
                    else:
                        every = every or [(a, b, _whole(q, None)) for a, b, q in zip(*(plain.field(c).to_pylist() for c in ("id", "number", "q")), strict=True)]
                        mine = _whole(None, r["wide"])
                        found = [(_dot(mine, v), a) for a, b, v in every if b != r["number"]]
                    if exact:
                        mine = _whole(r["q"], r["wide"])
                        found += [(_dot(mine, v), a) for a, b, v in exact if b != r["number"]]
                    found = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
                    out[0] += [r["id"]] * len(found)
                    out[1] += [r["number"]] * len(found)
                    out[2] += [f[1] for f in found]
                    out[3] += [min(max(f[0], _LONG[0]), _LONG[1]) for f in found]
                    out[4] += [not _LONG[0] <= f[0] <= _LONG[1] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.bool_()], strict=True)], names=["query_id", "number", "vec_id", "score", "beyond"])

    schema = "query_id long, number long, vec_id long, score long, beyond boolean"
    found = left.join(right.hint("shuffle_hash"), ["block", "group"]).repartition(max(n_blocks * n_groups, 1), "block", "group").select("rows", "queries").mapInArrow(search, schema)
    best = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("beyond"), F.raise_error(F.lit("a score does not fit a long"))).otherwise(F.col("score"))
    return found.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))
