"""Tree ensembles from a node table: small ones as one column expression, others as arrays walked by a kernel."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (tree, node, feature, threshold, left, right, p): a small fixed ensemble for tests and demonstrations.
DEMO_TREES = (
    (0, 0, "ndvi_amplitude_h1", 0.02, 1, 2, None), (0, 1, "ndvi_offset", 0.72, 3, 4, None), (0, 2, "crswir_offset", 0.16, 5, 6, None),
    (0, 3, None, None, None, None, 0.35), (0, 4, None, None, None, None, 0.85), (0, 5, None, None, None, None, 0.15), (0, 6, None, None, None, None, 0.6),
    (1, 0, "nbr_cos_phase_h1", 0.1, 1, 2, None), (1, 1, "elevation", 1000.0, 3, 4, None), (1, 2, "evi_amplitude_h2", 0.05, 5, 6, None),
    (1, 3, None, None, None, None, 0.25), (1, 4, None, None, None, None, 0.75), (1, 5, None, None, None, None, 0.45), (1, 6, None, None, None, None, 0.1),
    (2, 0, "crswir_amplitude_h1", 0.03, 1, 2, None), (2, 1, "nbr_offset", 0.6, 3, 4, None), (2, 2, "ndvi_cos_phase_h2", 0.0, 5, 6, None),
    (2, 3, None, None, None, None, 0.2), (2, 4, None, None, None, None, 0.9), (2, 5, None, None, None, None, 0.5), (2, 6, None, None, None, None, 0.05),
)


NODES = "tree int, node int, feature string, threshold double, left int, right int, p double"


def save_nodes(spark: SparkSession, nodes: Iterable[tuple], path: str) -> None:
    spark.createDataFrame(list(nodes), NODES).coalesce(1).write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str, most: int = 1_000_000) -> list[tuple]:
    """A stored node table; Spark's error if there is none, ValueError if it is no model (empty or over ``most`` nodes)."""
    rows = spark.read.schema(NODES).parquet(path).limit(most + 1).collect()
    if not 0 < len(rows) <= most:
        raise ValueError(f"{path}: {len(rows)} nodes")
    return [tuple(r) for r in rows]


def ensemble(nodes: Iterable[tuple], features: Iterable[str] | None = None) -> Column:
    """Mean leaf probability; a sample goes left where its feature is at most the threshold."""
    trees: dict[int, dict[int, tuple]] = {}
    for tree, node, *rest in nodes:
        trees.setdefault(tree, {})[node] = tuple(rest)
    known = set(features) if features is not None else None

    def branch(tree: dict[int, tuple], node: int) -> Column:
        feature, threshold, left, right, p = tree[node]
        if feature is None:
            return F.lit(float(p))
        if known is not None and feature not in known:
            raise ValueError(f"the model needs {feature}")
        return F.when(F.col(feature) <= threshold, branch(tree, left)).otherwise(branch(tree, right))

    each = [branch(t, 0) for _, t in sorted(trees.items())]
    return sum(each[1:], each[0]) / float(len(each))


#: Ensembles of more nodes are walked as arrays: an expression of all their branches would not compile.
EXPRESSION_NODES = 256


class Forest:
    """A tree ensemble as flat arrays: each node's feature (-1 in a leaf), threshold, children and probability."""

    def __init__(self, nodes: Iterable[tuple]):
        nodes = sorted(nodes, key=lambda x: (x[0], x[1]))
        place = {(tree, node): i for i, (tree, node, *_) in enumerate(nodes)}
        self.features = sorted({x[2] for x in nodes if x[2] is not None})
        number = {f: i for i, f in enumerate(self.features)}
        self.feature = np.array([-1 if x[2] is None else number[x[2]] for x in nodes], np.int32)
        self.threshold = np.array([x[3] or 0.0 for x in nodes], float)
        self.left = np.array([i if x[2] is None else place[x[0], x[4]] for i, x in enumerate(nodes)], np.int32)
        self.right = np.array([i if x[2] is None else place[x[0], x[5]] for i, x in enumerate(nodes)], np.int32)
        self.p = np.array([x[6] or 0.0 for x in nodes], float)
        self.roots = [place[t, 0] for t in sorted({x[0] for x in nodes})]

    def probability(self, values: np.ndarray) -> np.ndarray:
        """Mean leaf probability of each row of ``values`` (columns in order of ``features``)."""
        total, rows = np.zeros(len(values)), np.arange(len(values))
        for root in self.roots:
            at = np.full(len(values), root, np.int32)
            while (inner := self.feature[at] >= 0).any():
                go_left = values[rows[inner], self.feature[at[inner]]] <= self.threshold[at[inner]]
                at[inner] = np.where(go_left, self.left[at[inner]], self.right[at[inner]])
            total += self.p[at]
        return total / len(self.roots)


def walk(features: DataFrame, nodes: Iterable[tuple]) -> DataFrame:
    """Adds ``probability`` by walking the nodes' arrays, which go to the executors with the function (a million nodes: 32 MB)."""
    forest = Forest(nodes)
    if missing := set(forest.features) - set(features.columns):
        raise ValueError(f"the model needs {sorted(missing)}")
    names = features.columns

    def fn(batches):
        for b in batches:
            values = np.stack([b.column(names.index(f)).to_numpy(zero_copy_only=False).astype(float) for f in forest.features], axis=1) if forest.features else np.empty((b.num_rows, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.probability(values), pa.float64())], names=[*names, "probability"])

    return features.mapInArrow(fn, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema] + ["probability double"]))


def score(features: DataFrame, nodes: Iterable[tuple] = DEMO_TREES) -> DataFrame:
    """Adds ``probability`` of the evergreen class; null features count as 0."""
    nodes, filled = list(nodes), features.na.fill(0.0, [c for c, t in features.dtypes if t == "double"])
    if len(nodes) > EXPRESSION_NODES:
        return walk(filled, nodes)
    return filled.withColumn("probability", ensemble(nodes, features.columns))
