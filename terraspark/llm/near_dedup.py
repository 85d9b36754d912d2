"""Near-duplicate groups by a chosen-path set similarity join.

Texts are sets of 5-word shingles; two are linked at Jaccard similarity >= 3/4.

* Texts of equal sets collapse to a class.  A class has a number of its own, fixed
  once it is written: a row's key does not name it, so several texts under one key
  stay apart.
* ``TREES`` independent trees branch all classes.  A node selects coordinates of the
  minwise signature (its chosen tokens) and sends each class to the child of its
  value there.  The first level selects two coordinates a tree, so a pair at the
  threshold parts in all trees with probability 0.25 ** 16.
* A node of at most ``NODE_MAX`` classes and ``NODE_SHINGLES`` shingles is compared
  exhaustively.  Larger ones branch on: one or two further coordinates (3/2 on
  average, more than the inverse of the threshold), until they are small.  At
  ``DEPTH_MAX`` what is left is cut into blocks, by classes and by shingles, and
  every pair of blocks is compared.
* Nodes of equal members are compared once.  In a node of up to ``PAIRS_MAX`` classes
  the pairs that look similar by signature are candidates.  They are confirmed on
  whole sets of 64-bit shingle hashes in cells of two hash ranges of classes; a class
  is sent once to each of its cells.
* In a larger node, rows that look similar by signature to no other (or only to rows
  they are joined with) drop out first; the others get their whole sets.  They join
  groups one by one, confirmed on the sets, likeliest first, and rows already in one group are not compared again:
  whatever the number of similar pairs, a node gives fewer links than it has rows.
* Larger nodes of the first two trees, if not to be branched, are compared before all
  others; a node whose classes are all joined by them can't join more, and its sets are
  not sent.
  Candidate pairs that are joined already are not confirmed either.
  Nodes of more than ``ALONE`` classes are a group of their own; smaller ones are
  pooled by hash, by their classes and shingles.
* Components come from alternating star steps over the confirmed links.

The signature has 256 values of 4 bits: its estimate is off by 0.028 (one standard
deviation) at the threshold, and candidates begin at 0.64, so a pair exactly at the
threshold is overlooked with probability about 5e-5 and one at 0.78 never.  If all
the coordinates that such a pair shares lie in large nodes, it parts in all trees
with probability 1e-7 when they are small after one further level, 1e-5 after three
and 2e-4 after the seven there are; at a similarity of 0.9 with 3e-11 after seven.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from . import kernels as K
from . import tables as T

WORDS = 5
TREES = 8
PATHS = 2 * TREES
VALUES = 256
PAIRS_MAX = 8
NODE_MAX = 2048
#: Nodes of more classes, or of a thousand times as many shingles, are compared alone.
ALONE = 128
#: Rows of a pool of nodes that are compared by signature (128 bytes each), about.
NEAR_ROWS = 4096
#: Shingles of all sets in a node, at most (32 MB).
NODE_SHINGLES = 1 << 22
DEPTH_MAX = 8
#: Paths whose larger nodes are compared first (two trees).
FIRST_PATHS = 4
ESTIMATE_MIN = 0.64

_U32 = np.uint32
_FLIP = K.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(_U32)
_TIMES = (K.mix(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(_U32) | _U32(1)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values (32 bits) of one set under 256 permutations, and the whole tokens that the first ``PATHS`` choose."""
    x = (hashes >> np.uint64(32)).astype(_U32)
    step = max(PATHS, min(VALUES, (1 << 20) // max(len(x), 1)))
    out, tokens = np.empty(VALUES, _U32), None
    for a in range(0, VALUES, step):
        y = (x[None, :] ^ _FLIP[a : a + step, None]) * _TIMES[a : a + step, None]
        out[a : a + step] = y.min(axis=1)
        if tokens is None:
            tokens = hashes[y[:PATHS].argmin(axis=1)]
    return out, tokens


def _packed(values: np.ndarray) -> bytes:
    """Four bits of each value, two to a byte."""
    x = values ^ (values >> _U32(15))
    x = ((x * _U32(0x2C1B3C6D)) >> _U32(28)).astype(np.uint8)
    return (x[0::2] << 4 | x[1::2]).tobytes()


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of 256 small numbers."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES // 2)
    out = np.empty((len(x), VALUES), np.uint8)
    out[:, 0::2], out[:, 1::2] = x >> 4, x & 15
    return out


def _estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal values, of which one in sixteen is so by chance."""
    return (equal - 1 / 16) / (1 - 1 / 16)


def _set_key(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


_SIGNED = "id long, n_shingles long, set_key binary, paths array<long>, sig binary"


def _signed(documents: DataFrame, key: str, text: str) -> DataFrame:
    def fn(batches):
        for batch in batches:
            raw, offsets = K.texts_of(batch.column(1))
            ids = batch.column(0)
            for a, b in K.chunked(offsets):
                o = offsets[a : b + 1]
                hashes, begin = K.shingle_sets(raw[o[0] : o[-1]], o - o[0], WORDS)
                keys, paths, sigs = [], [], []
                for i in range(b - a):
                    s = hashes[begin[i] : begin[i + 1]]
                    if not len(s):
                        keys.append(None), paths.append(None), sigs.append(None)
                        continue
                    v, chosen = signature(s)
                    keys.append(_set_key(s.tobytes()))
                    paths.append(chosen.view(np.int64))
                    sigs.append(_packed(v))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(np.diff(begin), pa.int64()), pa.array(keys, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["id", "n_shingles", "set_key", "paths", "sig"],
                )

    return documents.select(key, text).mapInArrow(fn, _SIGNED)


_PAIRS = "a long, b long"
_NEAR = "path int, node long, id long, side int, component long, n_shingles long, sig binary, n long, shingles long"


def _nodes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their nodes, where each node begins, and its size."""
    node, path = table["node"].to_numpy(), table["path"].to_numpy()
    order = np.lexsort((node, path))
    cut = np.flatnonzero(np.r_[True, (node[order][1:] != node[order][:-1]) | (path[order][1:] != path[order][:-1])])
    return order, cut, np.diff(np.r_[cut, len(order)])


def _linked_in_nodes(table: pa.Table) -> pa.Table:
    """Confirmed links that join what is linked in each node of one group of nodes."""
    ids, sizes, side, component = (table[c].to_numpy() for c in ("id", "n_shingles", "side", "component"))
    sigs = _unpacked(table["sig"])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
    order, cut, counts = _nodes(table)
    u, v = [], []
    for begin, n in zip(cut.tolist(), counts.tolist(), strict=True):
        # Small sets first: a row's partners lie in a range of sizes.
        rows = order[begin : begin + n]
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        group = component[rows]
        low = np.searchsorted(4 * sizes[rows], 3 * sizes[rows], side="left")
        for k in range(1, n):
            others = np.arange(low[k], k)
            others = others[group[others] != group[k]]
            if (s := side[rows[k]]) != 0:
                # In a node of two blocks, only pairs across them.
                others = others[side[rows[others]] != s]
            same = (sigs[rows[others]] == sigs[rows[k]]).mean(axis=1)
            near = _estimate(same) >= ESTIMATE_MIN
            others = others[near][np.argsort(-same[near], kind="stable")]
            step = 1
            while len(others):
                others = others[group[others] != group[k]]
                for j, linked in zip(others[:step].tolist(), _linked(sets[rows[k]], [sets[r] for r in rows[others[:step]]]), strict=True):
                    if linked and group[j] != group[k]:
                        u.append(ids[rows[k]])
                        v.append(ids[rows[j]])
                        group[group == group[k]] = group[j]
                others, step = others[step:], min(2 * step, 64)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _near_in_nodes(table: pa.Table) -> pa.Table:
    """The rows that look similar, by signature, to one of their node in another component, with the size of what stays of each node."""
    sizes, side, component = (table[c].to_numpy() for c in ("n_shingles", "side", "component"))
    sigs = _unpacked(table["sig"])
    order, cut, counts = _nodes(table)
    stay, n, shingles = [order[:0]], [order[:0]], [order[:0]]
    for begin, count in zip(cut.tolist(), counts.tolist(), strict=True):
        rows = order[begin : begin + count]
        size, group, block, mine = sizes[rows], component[rows], side[rows], sigs[rows]
        found, later = np.zeros(count, dtype=bool), np.ones(count, dtype=bool)
        for k in range(count):
            later[k] = False
            if found[k]:
                continue
            # Earlier rows that found nothing have been held against this one.
            fit = (later | found) & (group != group[k]) & (4 * np.minimum(size, size[k]) >= 3 * np.maximum(size, size[k]))
            if block[k] != 0:
                fit &= block != block[k]
            others, step = np.flatnonzero(fit), 64
            while len(others) and not found[k]:
                some, others, step = others[:step], others[step:], 4 * step
                near = some[_estimate(np.count_nonzero(mine[some] == mine[k], axis=1) / VALUES) >= ESTIMATE_MIN]
                found[near], found[k] = True, len(near) > 0
        stay.append(rows[found])
        n.append(np.full(found.sum(), found.sum()))
        shingles.append(np.full(found.sum(), size[found].sum()))
    out = table.select(["path", "node", "id", "side", "component", "n_shingles", "sig"]).take(pa.array(np.concatenate(stay), pa.int64()))
    return out.append_column("n", pa.array(np.concatenate(n), pa.int64())).append_column("shingles", pa.array(np.concatenate(shingles), pa.int64()))


def _linked(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets have 3/4 of the union in common with ``one``."""
    if not others:
        return np.empty(0, dtype=bool)
    every, sizes = np.concatenate(others), np.array([len(x) for x in others])
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    inter = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * inter >= 75 * (len(one) + sizes - inter)


def _in_nodes(table: pa.Table) -> pa.Table:
    """Candidates of all nodes in one group of nodes of pairs."""
    ids, size, sigs = table["id"].to_numpy(), table["n_shingles"].to_numpy(), _unpacked(table["sig"])
    order, cut, counts = _nodes(table)
    a, b = [], []
    for n in np.unique(counts).tolist():
        # All nodes of one size at once.
        x, y = np.triu_indices(n, 1)
        rows = order[cut[counts == n][:, None] + np.arange(n)]
        for k in range(0, len(rows), 512):
            i, j = rows[k : k + 512, x].ravel(), rows[k : k + 512, y].ravel()
            fit = 4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j])
            i, j = i[fit], j[fit]
            near = _estimate((sigs[i] == sigs[j]).mean(axis=1)) >= ESTIMATE_MIN
            a.append(np.minimum(ids[i[near]], ids[j[near]]))
            b.append(np.maximum(ids[i[near]], ids[j[near]]))
    # A pair that meets in several nodes is sent on once.
    found = np.unique(np.stack([np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])], axis=1), axis=0)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


class _Search:
    """The nodes of all trees, level by level, with what each level finds.  An ``id`` is a class's number."""

    def __init__(self, classes: DataFrame, documents: DataFrame, key: str, text: str):
        self.classes, self.documents, self.key, self.text = classes, documents, key, text
        self.pairs: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.joined: DataFrame | None = None

    def whole_sets(self, ids: DataFrame) -> DataFrame:
        """``(id, shingles)`` of the classes named in ``ids``."""
        named = self.classes.select("id", "set_key", F.col("doc").alias(self.key)).join(ids.select("id").distinct(), "id", "left_semi")
        named = T.written(named, "wanted")
        small = named.count() <= BROADCAST_IDS
        hint = F.broadcast if small else lambda x: x
        needed = self.documents.join(hint(named.select(self.key).distinct()), self.key, "left_semi")
        found = _sets(needed, self.key, self.text).join(hint(named.select("id", "set_key")), "set_key")
        # A repeated row gives the same set again: any one serves.
        return found.select("id", "shingles").dropDuplicates(["id"])

    def compare(self, nodes: DataFrame, level: str) -> None:
        """Compares the nodes (path, node, id, side, n, shingles) that are not large."""
        for name, part in (("pairs", nodes.where(F.col("n") <= PAIRS_MAX)), ("links", nodes.where(F.col("n") > PAIRS_MAX))):
            if name == "pairs":
                if not (count := part.count()):
                    continue
                rows = part.join(self.full, "id").withColumn("group", F.pmod(F.xxhash64("path", "node"), F.lit(T.parts_for(count, 20_000))))
                found = rows.select("group", "path", "node", "id", "n_shingles", "sig").groupBy("group").applyInArrow(_in_nodes, _PAIRS)
                self.pairs.append(T.written(found, f"pairs-{level}"))
            else:
                # What the first trees join at the first level need not be compared again.
                if level == "1":
                    self.join_up(part.where(F.col("path") < FIRST_PATHS), "first")
                    part = part.where(F.col("path") >= FIRST_PATHS)
                self.join_up(part, level)

    def with_component(self, rows: DataFrame, key: str = "id", name: str = "component") -> DataFrame:
        """``rows`` with the component that the links of the first trees give to the class in ``key``."""
        if self.joined is None:
            return rows.withColumn(name, F.col(key))
        known = self.joined.select(F.col("id").alias(key), F.col("component").alias(name))
        return rows.join(known, key, "left").withColumn(name, F.coalesce(name, key))

    def join_up(self, part: DataFrame, level: str) -> None:
        """Confirms links in nodes of more than ``PAIRS_MAX`` classes that are not all joined yet."""
        with T.temporary(self.documents.sparkSession) as kept:
            part = self.with_component(part)
            if self.joined is not None:
                apart = part.groupBy("path", "node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
                part = T.written(part.join(apart.select("path", "node"), ["path", "node"], "left_semi"), f"apart-{level}")
            # Signatures say which rows can be linked at all; the sets of these alone are sent.
            if not (count := part.count()):
                return
            pools = T.parts_for(count, NEAR_ROWS)
            rows = part.withColumn("group", F.pmod(F.xxhash64("path", "node"), F.lit(pools))).join(self.full, "id")
            rows = rows.select("group", "path", "node", "id", "side", "component", "n_shingles", "sig")
            part = T.written(rows.groupBy("group").applyInArrow(_near_in_nodes, _NEAR), f"near-{level}")
            count, shingles = part.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
            if not count:
                return
            pools = max(T.parts_for(count, 4 * ALONE), T.parts_for(shingles, 4000 * ALONE))
            alone = (F.col("n") > ALONE) | (F.col("shingles") > 1000 * ALONE)
            # Pools have numbers from 0 up, nodes alone negative ones.
            group = F.when(alone, -1 - F.shiftrightunsigned(F.xxhash64("path", "node"), 1)).otherwise(F.pmod(F.xxhash64("path", "node"), F.lit(pools)))
            sets = T.written(self.whole_sets(part), f"sets-{level}")
            rows = part.withColumn("group", group).select("group", "path", "node", "id", "n_shingles", "sig", "side", "component").join(sets, "id")
            found = T.written(rows.groupBy("group").applyInArrow(_linked_in_nodes, "u long, v long"), f"links-{level}")
            if level == "first":
                self.joined = T.written(components.smallest_reachable(found), "joined")
                kept.append(self.joined)
            else:
                self.links.append(found)
                kept.append(found)

    def run(self) -> None:
        large = (F.col("n") > NODE_MAX) | (F.col("n") > PAIRS_MAX) & (F.col("shingles") > NODE_SHINGLES)
        counted = [F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")]
        first = self.classes.select("id", "n_shingles", F.posexplode("paths").alias("path", "node"))
        # Nodes of equal members (two sums of their hashes agree) are compared once, unless they go on branching.
        members = [F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.sum(F.shiftright(F.xxhash64("id", F.lit(2)), 24)).alias("y")]
        counts = T.written(first.groupBy("path", "node").agg(*counted, *members).where("n > 1").withColumn("large", large), "node-sizes")
        once = counts.where(~F.col("large")).groupBy("n", "shingles", "x", "y").agg(F.min(F.struct("path", "node")).alias("one")).select("one.path", "one.node", "n", "shingles", F.lit(False).alias("large"))
        counts = T.written(once.union(counts.where("large").select("path", "node", "n", "shingles", "large")).withColumn("n_rows", F.col("n")), "nodes-once")
        # Only classes that share a node with another go on.
        shared = T.written(T.joined(first.drop("n_shingles"), counts, ["path", "node"], "n_rows", PATHS * self.classes.count()), "nodes")
        full = self.classes.select("id", "n_shingles", "sig").join(shared.select("id").distinct(), "id", "left_semi")
        self.full = T.written(full, "active")
        self.compare(shared.where(~F.col("large")).select("path", "node", "id", F.lit(0).alias("side"), "n", "shingles"), "1")
        rest = shared.where("large").select("id", "path", "node")
        for depth in range(2, DEPTH_MAX + 1):
            rest = T.written(rest, f"large-{depth}")
            if rest.isEmpty():
                return
            # A node selects one or two coordinates by its own name; its classes part by their values there.
            node = F.col("node")
            picks = F.array(
                F.pmod(F.xxhash64(node, F.lit(depth)), F.lit(VALUES)),
                F.when(F.pmod(F.xxhash64(node, F.lit(-depth)), F.lit(2)) == 0, F.pmod(F.xxhash64(node, F.lit(1000 + depth)), F.lit(VALUES))),
            )
            child = rest.withColumn("pick", F.explode(F.array_compact(picks))).join(self.full.select("id", "sig", "n_shingles"), "id")
            child = child.withColumn("node", F.xxhash64("node", "pick", F.expr("substring(hex(substring(sig, int(pick div 2) + 1, 1)), int(pick % 2) + 1, 1)"))).select("id", "path", "node", "n_shingles").distinct()
            child = T.written(child, f"parted-{depth}")
            counts = T.written(child.groupBy("path", "node").agg(*counted).where("n > 1").withColumns({"large": large, "n_rows": F.col("n")}), f"sizes-{depth}")
            child = T.written(T.joined(child.drop("n_shingles"), counts, ["path", "node"], "n_rows"), f"children-{depth}")
            self.compare(child.where(~F.col("large")).select("path", "node", "id", F.lit(0).alias("side"), "n", "shingles"), str(depth))
            rest = child.where("large").select("id", "path", "node", "n", "shingles")
        # The exact way for what no branching made small: blocks of each node against blocks.
        blocks = F.greatest(F.ceil(F.col("n") / (NODE_MAX / 2)), F.ceil(F.col("shingles") / (NODE_SHINGLES / 2)), F.lit(1))
        dealt = rest.withColumn("k", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
        dealt = dealt.withColumn("node", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")))
        # Side 0: a block with itself; else pairs across the two blocks only.
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") > F.col("other"), 1).otherwise(2)
        self.compare(dealt.select("path", "node", "id", side.alias("side"), F.lit(NODE_MAX).alias("n"), F.lit(NODE_SHINGLES).cast("long").alias("shingles")), "rest")


def _confirm(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of one cell: its candidate pairs against its classes' whole sets."""
    at = {i: k for k, i in enumerate(right["id"].to_pylist())}
    blobs = right["shingles"].combine_chunks()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in blobs]
    keep = [k for k, (a, b) in enumerate(zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True)) if _linked(sets[at[a]], [sets[at[b]]])[0]]
    return left.select(["a", "b"]).take(pa.array(keep, pa.int64())).rename_columns(["u", "v"])


def _sets(documents: DataFrame, key: str, text: str) -> DataFrame:
    def fn(batches):
        for batch in batches:
            raw, offsets = K.texts_of(batch.column(1))
            for a, b in K.chunked(offsets):
                o = offsets[a : b + 1]
                hashes, begin = K.shingle_sets(raw[o[0] : o[-1]], o - o[0], WORDS)
                sets = [hashes[begin[i] : begin[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "shingles"])

    return documents.select(key, text).mapInArrow(fn, "set_key binary, shingles binary")


#: Class ids with a candidate, and keys of rows that go, are broadcast up to this many (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def links(classes: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Confirmed links ``(u, v)`` that join all that is linked, between the numbers of ``classes`` (id, set_key, doc, n_shingles, paths, sig), written."""
    with T.temporary(documents.sparkSession) as kept:
        search = _Search(classes, documents, key, text)
        search.run()
        found = search.links + ([search.joined.toDF("u", "v")] if search.joined is not None else [])
        if search.pairs:
            pairs = search.pairs[0]
            for more in search.pairs[1:]:
                pairs = pairs.union(more)
            pairs = search.with_component(search.with_component(pairs.distinct(), "a", "of_a"), "b", "of_b")
            pairs = T.written(pairs.where("of_a <> of_b").select("a", "b"), "candidates")
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            sets = search.whole_sets(wanted)
            n, shingles = wanted.join(search.full, "id").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
            ranges = max(T.parts_for(n, 12_000, 6), T.parts_for(shingles, NODE_SHINGLES))
            mine = lambda c: F.pmod(F.xxhash64(c), F.lit(ranges))
            cells = pairs.withColumn("lo", F.least(mine("a"), mine("b"))).withColumn("hi", F.greatest(mine("a"), mine("b")))
            sent = cells.select(F.col("lo").alias("row"), F.col("hi").alias("column"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")
            found.append(cells.groupBy("lo", "hi").cogroup(sent.groupBy("row", "column")).applyInArrow(_confirm, "u long, v long"))
        out = documents.sparkSession.createDataFrame([], "u long, v long")
        for more in found:
            out = out.union(more)
        out = T.written(out, "confirmed")
        kept.append(out)
    return out


def with_set_key(documents: DataFrame, text: str = "text", name: str = "set_key") -> DataFrame:
    """All columns of ``documents`` with the name of the text's shingle set (null: no shingles)."""
    documents = documents.drop(name)
    names = documents.columns

    def fn(batches):
        for batch in batches:
            raw, offsets = K.texts_of(batch.column(names.index(text)))
            keys = []
            for a, b in K.chunked(offsets):
                o = offsets[a : b + 1]
                hashes, begin = K.shingle_sets(raw[o[0] : o[-1]], o - o[0], WORDS)
                keys += [_set_key(hashes[x:y].tobytes()) if y > x else None for x, y in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*names, name])

    return documents.mapInArrow(fn, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema] + [f"`{name}` binary"]))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row of ``documents``.

    ``with_groups`` adds ``set_key``, the name of the row's shingle set, and ``group``, a
    number of its component: two components may have one name if a key is repeated.

    Words end at ASCII white space and A-Z count as a-z.  A text of fewer than five
    words is one shingle; a null or empty text, or one of white space only, has none
    and is linked with nothing.  Each row is a document: rows of equal texts, repeated
    rows included, share a component, and several texts under one key are not linked
    by it.  A component is named by the smallest key of its rows; of several rows with
    that key all are kept.  Rows with a null key are dropped, as no component could
    name them.  Texts of any length are read whole, piece by piece.  Other columns are
    not read; an empty table gives an empty table.
    """
    documents = documents.select(key, text).where(F.col(key).isNotNull())
    signed = T.written(_signed(documents, key, text), "signed")
    # All but the key follows from the set, so any row of a class will do.
    classes = signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("id").alias("doc"), F.count("*").alias("n_rows"), *[F.first(c).alias(c) for c in ("n_shingles", "paths", "sig")])
    classes = T.written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = links(classes, documents, key, text)
    linked = T.written(components.smallest_reachable(found), "reached")
    # Components of more than one class are named by the smallest key of all their rows.
    linked = T.written(linked.union(linked.select("component", "component").distinct()).join(classes.select("id", "doc"), "id"), "linked")
    ends = linked.groupBy("component").agg(F.min("doc").alias("end"), F.count("*").alias("n"))
    ended = T.joined(linked, ends, "component", "n").select("id", "end", "component")
    named = classes.select("id", "set_key", "doc", "n_rows").join(ended, "id", "left")
    named = T.written(named.select("set_key", "n_rows", F.coalesce("end", "doc").alias("end"), F.coalesce("component", "id").alias("group")), "named")
    rows = signed.select("id", "n_shingles", "set_key")
    with_set = T.joined(rows.where(F.col("set_key").isNotNull()), named, "set_key", "n_rows")
    out = with_set.unionByName(rows.where(F.col("set_key").isNull()).withColumns({"end": F.col("id"), "group": F.lit(None).cast("long")}))
    more = ["set_key", "group"] if with_groups else []
    return out.select(F.col("id").alias(key), "n_shingles", F.col("end").alias("component_id"), (F.col("id") == F.col("end")).alias("kept"), *more)


def without_copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate component: one with the smallest key, whole, all columns.

    Rows without words stay, each for itself, and so do rows with a null key, which are
    not compared.  If the smallest key has several rows in a component (repeated rows,
    or several texts under one key), one of them stays, that with the smallest set name.
    """
    spark = documents.sparkSession
    with T.temporary(spark) as kept:
        groups = T.written(near_duplicates(documents, key, text, with_groups=True), "groups")
        # A row without words is no member of any group, and kept.
        per_key = T.written(groups.groupBy(key).agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept")), "per-key")
        kept += [groups, per_key]
    # Keys none of whose rows is kept go at once; keys of several rows are looked at row by row.
    gone, odd = per_key.where("n_kept = 0").select(key), per_key.where("n > 1 and n_kept > 0").select(key)
    away = gone.union(odd)
    if away.count() <= BROADCAST_IDS:
        # Else, as the size of the filtered keys isn't known beforehand, all texts would be shuffled for a few keys.
        away = F.broadcast(away)
    if odd.isEmpty():
        return documents.join(away, key, "left_anti")
    stay = groups.where("kept and group is not null").groupBy("group", key).agg(F.min("set_key").alias("set_key")).select(key, "set_key")
    several = with_set_key(documents.join(odd, key, "left_semi"), text)
    one = several.join(stay, [key, "set_key"], "left_semi").dropDuplicates([key, "set_key"])
    several = one.unionByName(several.where(F.col("set_key").isNull())).drop("set_key")
    return documents.join(away, key, "left_anti").unionByName(several)
