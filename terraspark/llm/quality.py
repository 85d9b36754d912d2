"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Each token has two names: its word (letters in lower case) and its form (case,
digits, trailing signs, whether it repeats the token before).  A name's index
vector is sparse and ternary and follows from its hash alone.  A word's vector is
the sum of the index vectors of the words around it in the training texts, beside
that of their forms; words are told apart by 64-bit hashes, and one that is not among the
``KNOWN_MOST`` most frequent there falls back on its form's vector.  Both halves of a vector have norm 1
and are kept in steps of 1/127.  A text is the mean of its tokens'
vectors, beside the mean of its forms' index vectors.  The network has one hidden layer, and its logit is divided by a
temperature fitted on rows kept out of training, so scores are probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import kernels as K
from . import samples

DIM = 48
FORMS = 1024
NEIGHBOURS = (-2, -1, 1, 2)
#: Words with a vector of their own, at most, the most frequent ones: bounds the model that goes to the executors (7 MB).
KNOWN_MOST = 1 << 16
#: Steps of a vector's component.
STEPS = 127
#: Tokens whose neighbours are summed at a time.
BLOCK = 1 << 14
#: Labelled documents used for fitting, at most (bytes: ``samples.LEARN_BYTES``).
TRAIN_LIMIT = 4000
THRESHOLD = 0.3

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.uint8)
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
#: Classes of a token's last byte.
_LAST = np.zeros(256, np.int64)
for _i, _c in enumerate((".", ",;:", "!", "?", "*#$%&@^~", "|", ")]}>\"'", "0123456789"), 1):
    _LAST[[ord(c) for c in _c]] = _i


def index_vectors(names: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors of hashed names: eight entries of +1 or -1."""
    out = np.zeros((len(names), DIM), np.float32)
    rows = np.arange(len(names))
    for k in range(8):
        h = K.mix(names.astype(np.uint64) + np.uint64(0x1000193 * (k + 1)))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), np.float32(1), np.float32(-1)))
    return out


_FORM_INDEX = index_vectors(np.arange(FORMS) + (1 << 40))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and form of each token, and the index of each row's first token."""
    starts, ends, first = K.word_bounds(raw, offsets)
    if not len(starts):
        return np.empty(0, K.U64), np.empty(0, np.int64), first
    words = K.word_hashes(raw, starts, ends, lower=True)

    def count(of: np.ndarray) -> np.ndarray:
        sums = np.empty(len(raw) + 1, np.int32)
        sums[0] = 0
        np.cumsum(of[raw], out=sums[1:], dtype=np.int32)
        return sums[ends] - sums[starts]

    n = ends - starts
    up, low, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    other = n - up - low - digit
    case = np.where(up == 0, 0, np.where(low == 0, np.where(up > 1, 3, 1), np.where(up > 1, 2, 1)))
    kind = np.where(digit == 0, 0, np.where(digit == n, 2, 1))
    signs = np.minimum(other, 3)
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = 0
    # 4 * 3 * 4 * 9 * 2 = 864 forms
    form = (((case * 3 + kind) * 4 + signs) * 9 + _LAST[raw[ends - 1]]) * 2 + same
    return words, form, first


@dataclass
class Model:
    #: Sorted hashes of the words of the training texts.
    known: np.ndarray
    #: A row for each known word, then one for each form.
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def rows_of(self, words: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Row of each token in the vectors: its word's, or its form's where the word is unknown."""
        out = len(self.known) + forms
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            found = self.known[at] == words
            out[found] = at[found]
        return out

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, and the sums of their vectors and of their forms' index vectors."""
        words, forms, first = tokens(raw, offsets)
        counts = np.diff(first)
        out = np.zeros((len(counts), 3 * DIM), np.float32)
        rows = np.flatnonzero(counts)
        if len(rows):
            vectors = self.vectors[self.rows_of(words, forms)]
            out[rows, : 2 * DIM] = np.add.reduceat(vectors, first[rows], axis=0, dtype=np.float32) / STEPS
            # Forms are few: pool them by their counts.
            place = np.repeat(np.arange(len(counts)), counts) * FORMS + forms
            out[:, 2 * DIM :] = np.bincount(place, minlength=len(counts) * FORMS).reshape(-1, FORMS).astype(np.float32) @ _FORM_INDEX
        return counts, out

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean vectors of all texts; a long one is summed up over its pieces."""
        counts, out = np.zeros(len(offsets) - 1, np.int64), np.zeros((len(offsets) - 1, 3 * DIM), np.float32)
        for a, b, low, high in K.pieces(raw, offsets, 1 << 19):
            # Many rows of no text make one chunk: bound the rows too.
            for c in range(a, b, 1024):
                e = min(b, c + 1024)
                inner = np.clip(offsets[c : e + 1], low, high)
                n, s = self.sums(raw[inner[0] : inner[-1]], inner - inner[0])
                counts[c:e] += n
                out[c:e] += s
        return out / np.maximum(counts, 1)[:, None].astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, column: pa.Array) -> np.ndarray:
        """Calibrated probability of label 1 for each whole text."""
        raw, offsets = K.texts_of(column)
        out = np.zeros(len(offsets) - 1)
        # Bounds the pooled rows held at a time.
        for a in range(0, len(out), 1 << 14):
            o = offsets[a : a + (1 << 14) + 1]
            out[a : a + len(o) - 1] = self.logits(self.pooled(raw[o[0] : o[-1]], o - o[0]))
        return 1 / (1 + np.exp(-np.clip(out / self.temperature, -30, 30)))


def _context_vectors(names: np.ndarray, words: np.ndarray, forms: np.ndarray, first: np.ndarray, slots: int, word_index: np.ndarray) -> np.ndarray:
    """Normalised sums of the neighbours' word and form index vectors for each of ``slots`` names."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    total = np.zeros((slots, 2 * DIM), np.int8)
    order = np.argsort(names, kind="stable")
    # A name's tokens may go on in the next block: the last sum is carried over and its row written again.
    last, carried = -1, np.zeros(2 * DIM, np.float32)
    for a in range(0, len(order), BLOCK):
        at = order[a : a + BLOCK]
        near = np.zeros((len(at), 2 * DIM), np.float32)
        for gap in NEIGHBOURS:
            here = np.flatnonzero((at + gap >= 0) & (at + gap < len(row)))
            here = here[row[at[here]] == row[at[here] + gap]]
            near[here, :DIM] += word_index[words[at[here] + gap]]
            near[here, DIM:] += _FORM_INDEX[forms[at[here] + gap]]
        found = names[at]
        begin = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        sums = np.add.reduceat(near, begin, axis=0)
        if found[0] == last:
            sums[0] += carried
        last, carried = found[-1], sums[-1].copy()
        for half in (slice(0, DIM), slice(DIM, 2 * DIM)):
            total[found[begin], half] = np.rint(STEPS * sums[:, half] / np.maximum(np.linalg.norm(sums[:, half], axis=1, keepdims=True), 1e-6))
    return total


def fit(texts: list[str | None], labels: np.ndarray, hidden: int = 24, steps: int = 1500, seed: int = 0) -> Model:
    """Word vectors from the texts, then the network by Adam; a fifth of the rows sets the temperature."""
    raw, offsets = K.texts_of(pa.array(texts, pa.large_string()))
    pieces = []
    for a, b in K.chunked(offsets):
        o = offsets[a : b + 1]
        w, f, begin = tokens(raw[o[0] : o[-1]], o - o[0])
        pieces.append((w, f.astype(np.int16), np.diff(begin)))
    empty = np.empty(0, K.U64), np.empty(0, np.int16)
    hashes, forms = (np.concatenate([p[i] for p in pieces] or [empty[i]]) for i in range(2))
    first = np.cumsum(np.concatenate([[0], *(p[2] for p in pieces)])).astype(np.int64)
    del pieces
    known, words, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    del hashes
    words = words.astype(np.int32)
    word_index = np.zeros((len(known), DIM), np.int8)
    for a in range(0, len(known), BLOCK):
        word_index[a : a + BLOCK] = index_vectors(known[a : a + BLOCK])
    vectors = np.concatenate([_context_vectors(n, words, forms, first, slots, word_index) for n, slots in ((words, len(known)), (forms, FORMS))])
    del word_index, words, forms
    if len(known) > KNOWN_MOST:
        kept = np.sort(np.lexsort((known, -counts))[:KNOWN_MOST])
        vectors, known = np.concatenate([vectors[kept], vectors[len(known) :]]), known[kept]
    rng = np.random.default_rng(seed)
    w1, w2 = rng.normal(0, (3 * DIM) ** -0.5, (3 * DIM, hidden)), rng.normal(0, hidden**-0.5, hidden)
    model = Model(known, vectors, np.zeros(3 * DIM), np.ones(3 * DIM), w1, np.zeros(hidden), w2, 0.0, 1.0)
    if not len(labels):
        return model
    x = model.pooled(raw, offsets).astype(np.float64)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.scale
    kept = np.arange(len(x)) % 5 != 4 if len(x) >= 10 else np.ones(len(x), dtype=bool)
    params = [model.w1, model.b1, model.w2, np.zeros(1)]
    first_m, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    xs, ys = x[kept], labels[kept]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(xs), min(256, len(xs)))
        h = np.tanh(xs[at] @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        g = (p - ys[at]) / len(at)
        back = g[:, None] * params[2] * (1 - h * h)
        grads = [xs[at].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
        for k, grad in enumerate(grads):
            first_m[k] = 0.9 * first_m[k] + 0.1 * grad
            second_m[k] = 0.999 * second_m[k] + 0.001 * grad * grad
            params[k] -= 0.01 * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second_m[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    rest = ~kept if (~kept).any() else kept
    logits = np.tanh(x[rest] @ params[0] + params[1]) @ params[2] + params[3]
    grid = np.geomspace(0.5, 8, 60)
    loss = [np.mean(np.logaddexp(0, np.where(labels[rest] > 0, -1, 1) * logits / t)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def score(documents: DataFrame, labels: DataFrame, wanted: Column, label: str = "quality", key: str = "doc_id", text: str = "text", limit: int = TRAIN_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``key, score`` of every whole text, with the columns named in ``keep``.

    Learns from a ``samples.sample`` of ``limit`` labelled rows at most where ``wanted``
    holds.  Null and empty texts get the score of an all-zero mean vector; equal texts,
    repeated rows included, get equal scores; a null key is kept; a text of any length
    is read whole, piece by piece.  Other columns are not read; one of ``keep`` that is
    called ``score`` is replaced by the result.  Without any label all scores follow
    from the seeded network; an empty table gives an empty table.
    """
    model = samples.fitted(samples.sample(documents, labels, label, wanted, limit, key, text), lambda texts, y: fit(texts, np.array(y, dtype=float)))
    names = [key] if keep is None else [n for n in keep if n != "score"]

    def fn(batches):
        for b in batches:
            scores = model.score(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    fields = [documents.schema[n] for n in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    return documents.select(*dict.fromkeys([*names, text])).mapInArrow(fn, schema)
