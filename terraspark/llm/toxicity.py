"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the distinct words, word pairs and pairs with one word
between, hashed to 2**22 slots.  Per-coordinate learning rates let rare words learn
fast, and the L1 term leaves all but a few weights at exactly zero: the model is a
small sorted array that goes to the executors with the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import kernels as K
from . import samples

SLOTS_BITS = 22
#: Labelled documents used for fitting, at most (bytes: ``samples.LEARN_BYTES``).
TRAIN_LIMIT = 6000
THRESHOLD = 0.7

#: All ASCII bytes but letters, digits and the apostrophe end a word.
_ENDS_WORD = np.array([b < 128 and not (chr(b).isalnum() or b == 0x27) for b in range(256)])
_BIGRAM, _SKIP = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.word_bounds(raw, offsets, _ENDS_WORD)
    return K.word_hashes(raw, starts, ends, lower=True), first


def features(raw: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (with repeats) of all rows, and the row of each; ``before`` are the words before a piece of a text."""
    w, first = _words(raw, offsets)
    if before is not None:
        w, first = np.concatenate([before, w]), np.array([0, len(before) + len(w)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts, rows = [w], [row]
    for gap, salt in ((1, _BIGRAM), (2, _SKIP)):
        if len(w) > gap:
            both = row[:-gap] == row[gap:]
            parts.append(K.mix(w[:-gap][both] * salt + w[gap:][both]))
            rows.append(row[gap:][both])
    return (np.concatenate(parts) >> np.uint64(64 - SLOTS_BITS)).astype(np.int32), np.concatenate(rows)


@dataclass
class Model:
    slots: np.ndarray  # sorted slots of non-zero weights
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; a text without features has the bias alone."""
        raw, offsets = K.texts_of(column)
        out = np.full(len(offsets) - 1, self.bias)
        hot = np.zeros(1 << SLOTS_BITS, dtype=bool)
        hot[self.slots] = True
        gathered, before = np.empty(0, np.int64), None
        for a, b, low, high in K.pieces(raw, offsets):
            part, inner = raw[low:high], np.clip(offsets[a : b + 1], low, high) - low
            slots, rows = features(part, inner, before)
            keep = hot[slots]
            # A feature counts once in a text.
            seen = np.unique(np.concatenate([gathered, rows[keep].astype(np.int64) << SLOTS_BITS | slots[keep]]))
            if high < offsets[b]:
                # The pieces of a long text have one set of features; the last two words of a piece go on into the next.
                words = _words(part, inner)[0]
                gathered, before = seen, (words if before is None else np.concatenate([before, words]))[-2:]
                continue
            values = self.weights[np.searchsorted(self.slots, (seen & ((1 << SLOTS_BITS) - 1)).astype(np.int32))] if len(seen) else np.empty(0)
            out[a:b] += np.bincount(seen >> SLOTS_BITS, weights=values, minlength=b - a)
            gathered, before = np.empty(0, np.int64), None
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[str | None], labels: np.ndarray, alpha: float = 8.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.01, epochs: int = 12, seed: int = 0) -> Model:
    """FTRL-proximal over the texts in a seeded order; without texts a model that says 1/2."""
    z, n = np.zeros((1 << SLOTS_BITS) + 1), np.zeros((1 << SLOTS_BITS) + 1)
    raw, offsets = K.texts_of(pa.array(texts, pa.large_string()))
    sets = []
    for a, b in K.chunked(offsets):
        o = offsets[a : b + 1]
        slots, rows = features(raw[o[0] : o[-1]], o - o[0])
        cut = np.split(slots[np.argsort(rows, kind="stable")], np.cumsum(np.bincount(rows, minlength=b - a))[:-1])
        # The last slot is the bias.
        sets += [np.append(np.unique(x), 1 << SLOTS_BITS) for x in cut]

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) > l1, w, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(sets)).tolist():
            at = sets[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    active = np.flatnonzero(np.abs(z[:-1]) > l1).astype(np.int32)
    return Model(active, weights(active), float(weights(np.array([1 << SLOTS_BITS]))[0]))


def score(documents: DataFrame, labels: DataFrame, wanted: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", limit: int = TRAIN_LIMIT) -> DataFrame:
    """``key, score`` of every whole text; learns from a ``samples.sample`` of ``limit`` labelled rows at most where ``wanted`` holds.

    Null and empty texts get the model's prior; equal texts, repeated rows included,
    get equal scores; a null key is kept; a text of any length is read whole, piece by
    piece; other columns, whatever their names, are not read.  Without any label all
    scores are 1/2; an empty table gives an empty table.
    """
    model = samples.fitted(samples.sample(documents, labels, label, wanted, limit, key, text), lambda texts, y: fit(texts, np.array(y, dtype=float)))

    def fn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.score(b.column(1)), pa.float64())], names=[key, "score"])

    return documents.select(key, text).mapInArrow(fn, f"`{key}` long, score double")
