"""Bounded samples of labelled rows, and fitting on them in one task of the cluster."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T

#: Bytes of the texts learned from, at most, and of one of them: what is longer is not learned from.
LEARN_BYTES = 64 << 20
TEXT_BYTES = 4 << 20
#: Rows of each label (as many are expected, by a hash) that come before all others, so that a rare label is learned.
LEAST_EACH = 100
_TURNS = 1 << 20


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: the fold of a row; a null key has fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(0))


def sample(documents: DataFrame, labels: DataFrame, label: str, wanted: Column, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, label)`` of at most ``limit`` labelled rows and ``LEARN_BYTES`` of text, in one partition in key order.

    ``wanted`` says which rows may be learned from.  Each label's first ``LEAST_EACH``
    rows by a hash of the key come first, all others by that hash.  Null labels, labels
    of documents that don't exist and texts over ``TEXT_BYTES`` are left out; of a key's
    repeated rows the largest label and the largest text are used.
    """
    turn = F.xxhash64(key)
    pairs = labels.where(wanted & F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).alias("label"))
    # Of a label with many keys only a share by hash goes on, twice what may be taken.
    counts = T.written(pairs.groupBy("label").agg(F.approx_count_distinct(key).alias("n")), "label-counts")
    share = F.pmod(turn, F.lit(_TURNS)) * F.col("n") < F.lit(_TURNS * (2 * limit + 1000))
    ids = pairs.join(counts.hint("merge") if counts.count() > 100_000 else F.broadcast(counts), "label").where(share)
    early = F.pmod(turn, F.lit(_TURNS)) * F.col("n") >= F.lit(_TURNS * LEAST_EACH)
    ids = ids.groupBy(key).agg(F.max("label").alias("label"), F.min(early.cast("int")).alias("early"))
    ids = ids.orderBy("early", turn, key).limit(limit)
    # At most ``limit`` rows of a few bytes, so the broadcast is bounded; one row a key, however often it is repeated.
    rows = documents.where(F.coalesce(F.octet_length(text), F.lit(0)) <= TEXT_BYTES).select(key, text).join(F.broadcast(ids), key)
    rows = rows.groupBy(key).agg(F.max(text).alias(text), F.max("label").alias("label"), F.min("early").alias("early"))
    upto = F.sum(F.coalesce(F.octet_length(text), F.lit(0))).over(Window.orderBy("early", turn, key))
    return rows.withColumn("upto", upto).where(F.col("upto") <= LEARN_BYTES).select(key, text, "label").coalesce(1).sortWithinPartitions(key)


def fitted(rows: DataFrame, fit: Callable[[list, list], Any]) -> Any:
    """``fit(texts, labels)`` of a ``sample`` in one task, whatever the driver's memory; only the model comes back."""

    def fn(batches):
        texts, labels = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            labels += b.column(2).to_pylist()
        model = pickle.dumps(fit(texts, labels))
        texts.clear(), labels.clear()
        # The worker lives on: what the fit has freed goes back to the machine.
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(fn, "model binary").first()
    # An empty table may have no partition, and so no task.
    return pickle.loads(found[0]) if found else fit([], [])


def labelled(documents: DataFrame, labels: DataFrame, label: str, wanted: Column, limit: int, key: str = "doc_id", text: str = "text"):
    """The ``sample`` as a pandas frame in key order."""
    return sample(documents, labels, label, wanted, limit, key, text).toPandas().sort_values(key).reset_index(drop=True)
