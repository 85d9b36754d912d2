"""Connected components of a link table: forests of bounded parts, then alternating large-star and small-star steps.

A task joins up to ``PART_LINKS`` links to a forest.  If that is all of them, it is the
result; else the steps join the forests.  Both steps are a grouped minimum joined back;
a hub's edges are joined by broadcast (``tables.joined``), so that however many links
it has they are never gathered in one task.  Each step is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T

#: Links that one task joins at a time (4 MB).
PART_LINKS = 250_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links but the smallest of each component, and the smallest that it reaches by them."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (a, b) = np.arange(len(ids)), ends.reshape(2, -1)
    while len(a):
        # Ends are roots here: the larger of two goes below the smallest that it is linked with.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != np.arange(len(ids))
    return ids[below], ids[root[below]]


def _forests(per_part: int):
    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(u, v)], names=["u", "v"])

    def fn(batches):
        held = []
        for batch in batches:
            for a in range(0, batch.num_rows, per_part):
                part = batch.slice(a, per_part)
                if held and sum(x.num_rows for x in held) + part.num_rows > per_part:
                    yield joined(held)
                    held = []
                held.append(part)
        if held:
            yield joined(held)

    return fn


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Edges ``(u, v)`` with u > v after one step; ``edges`` is a written table of at most ``n`` rows, and so is what comes out."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        out = T.joined(both, low, "u", "n", 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = T.joined(edges, low, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return T.written(out.where(F.col("u") != F.col("v")).distinct(), "stars")


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links`` (u, v) but the components' own smallest ids.

    Runs to the fixed point.  Links of an id with itself and repeated links change nothing.
    """
    edges = T.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")), "links")
    parts = T.parts_for(edges.count(), PART_LINKS)
    edges = edges.coalesce(parts).mapInArrow(_forests(PART_LINKS), "u long, v long")
    if parts == 1:
        return edges.toDF("id", "component")
    edges = T.written(edges, "forests")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        # At the fixed point each id has one edge, to the smallest id it reaches.
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now
        with T.temporary(links.sparkSession) as kept:
            edges = _star(_star(edges, True, now[0]), False, now[0])
            kept.append(edges)
