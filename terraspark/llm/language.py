"""Language identification by word-first backoff.

A word known from training scores its log frequency in each language.  An unseen
word is cut into character n-grams: if some of its longest ones are known, it scores
their mean log frequency, else the next shorter ones are tried, down to single
characters.  A text's score is the sum over its words.  Words are runs of letters
and their combining marks in lower case; marks without any letter are no word.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import samples

#: Documents with a language used for fitting, at most (bytes: ``samples.LEARN_BYTES``).
TRAIN_LIMIT = 6000
LONGEST = 4
#: Words and n-grams seen less often than this are not known.
LEAST = 2
#: Words, and n-grams of each length, that are known, at most (the most frequent): bounds the model that goes to the executors.
KNOWN_MOST = 1 << 17
UNDECIDED = "und"
CHUNK_CHARS = 1 << 19

#: Filled on first use: for each code point whether it is neither letter nor mark, and whether it is a letter.
_kinds: list[np.ndarray] = []
#: Planes that hold letters (the basic one, and the first, second and third supplementary).
_PLANES = 4 << 16
_EDGE = np.uint64(0x51ED270B2F6D1C35)


def kinds() -> list[np.ndarray]:
    if not _kinds:
        import unicodedata

        ends_word, letter = np.ones(sys.maxunicode + 1, dtype=bool), np.zeros(sys.maxunicode + 1, dtype=bool)
        letter[:_PLANES] = [chr(i).isalpha() for i in range(_PLANES)]
        ends_word[:_PLANES] = [not (is_letter or unicodedata.category(chr(i)) in ("Mn", "Mc")) for i, is_letter in enumerate(letter[:_PLANES].tolist())]
        _kinds.extend([ends_word, letter])
    return _kinds


class Words:
    """Distinct words of some texts: hashes, code points and where each occurs."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        self.points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in lowered], out=offsets[1:])
        ends_word, letter = kinds()
        starts, ends, first = K.word_bounds(self.points, offsets, ends_word)
        sums = np.zeros(len(self.points) + 1, np.int32)
        np.cumsum(letter[self.points], out=sums[1:])
        real = sums[ends] > sums[starts]
        starts, ends, self.first = starts[real], ends[real], np.concatenate([[0], np.cumsum(real)])[first]
        self.codes = K.mix(self.points.astype(np.uint64) + np.uint64(1))
        hashes = K.window_hashes(self.codes, starts, ends - starts) ^ K.mix((ends - starts).astype(np.uint64))
        self.hashes, at, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[at], ends[at]

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character ``n``-grams of distinct words, and the place in ``which`` of each; edges count as characters."""
        a, b = self.starts[which], self.ends[which]
        size = b - a + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        marked = np.full(begin[-1], _EDGE, np.uint64)
        inner = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        is_char = (inner > 0) & (inner < np.repeat(size, size) - 1)
        marked[is_char] = self.codes[(np.repeat(a, size) + inner - 1)[is_char]]
        if n == 1:
            at = np.flatnonzero(is_char)
            return K.mix(marked[at] + np.uint64(1)), np.repeat(np.arange(len(which)), size)[at]
        at, first = K.window_starts(begin, n)
        return K.mix(K.window_hashes(marked, at, n) + np.uint64(n)), np.repeat(np.arange(len(which)), np.diff(first))


@dataclass
class Table:
    """Log frequencies by language of known hashes."""

    hashes: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: dict[int, Table]

    def scores(self, w: Words) -> np.ndarray:
        """Log scores of the distinct words in each language."""
        out = np.zeros((len(w.hashes), len(self.languages)))
        at = self.words.find(w.hashes)
        out[at >= 0] = self.words.logs[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            hashes, place = w.grams(rest, n)
            found = self.grams[n].find(hashes)
            known = found >= 0
            count = np.bincount(place[known], minlength=len(rest))
            for k in range(len(self.languages)):
                sums = np.bincount(place[known], weights=self.grams[n].logs[found[known], k], minlength=len(rest))
                out[rest[count > 0], k] = sums[count > 0] / count[count > 0]
            rest = rest[count == 0]
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and the sums of their log scores."""
        w = Words(texts)
        counts = np.diff(w.first)
        out = np.zeros((len(texts), max(len(self.languages), 1)))
        rows = np.flatnonzero(counts)
        if len(rows) and self.languages:
            out[rows] = np.add.reduceat(self.scores(w)[w.inverse], w.first[rows], axis=0)
        return counts, out

    def decide(self, counts: np.ndarray, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language (of equal ones the first by name) and probability of each text."""
        names, probability = [UNDECIDED] * len(counts), np.zeros(len(counts))
        rows = np.flatnonzero(counts)
        if len(rows) and self.languages:
            # Words of one text depend on each other: evidence grows with the root of their number.
            sums = sums[rows] / np.sqrt(counts[rows])[:, None]
            sums -= sums.max(axis=1, keepdims=True)
            best = sums.argmax(axis=1)
            probability[rows] = 1 / np.exp(sums).sum(axis=1)
            for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                names[r] = self.languages[b]
        return names, probability

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each whole text."""
        return self.decide(*self.sums(texts))

    def predict_column(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The same for a string column, chunk by chunk; a long text is summed up over its pieces."""
        raw, offsets = K.texts_of(column)
        counts, sums = np.zeros(len(column), np.int64), np.zeros((len(column), max(len(self.languages), 1)))
        for a, b, low, high in K.pieces(raw, offsets, CHUNK_CHARS):
            part = column.slice(a, b - a).to_pylist() if (low, high) == (offsets[a], offsets[b]) else [raw[low:high].tobytes().decode("utf-8", "replace")]
            n, s = self.sums(part)
            counts[a:b] += n
            sums[a:b] += s
        return self.decide(counts, sums)


class _Counts:
    """Counts of hashes by language, added up whenever many have gathered."""

    def __init__(self, languages: int):
        self.n, self.parts, self.waiting = languages, [], 0

    def add(self, hashes: np.ndarray, language: np.ndarray, weights: np.ndarray) -> None:
        values, place = np.unique(hashes, return_inverse=True)
        counts = np.bincount(place * self.n + language, weights=weights, minlength=len(values) * self.n)
        self.parts.append((values, counts.reshape(-1, self.n).astype(np.float32)))
        self.waiting += len(values)
        if self.waiting > 1 << 18:
            self.parts, self.waiting = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.zeros((0, self.n), np.float32)
        values, place = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        sums = np.zeros((len(values), self.n), np.float32)
        np.add.at(sums, place, np.concatenate([p[1] for p in self.parts]))
        return values, sums

    def table(self) -> Table:
        """Add-one-half log frequencies of the hashes seen at least ``LEAST`` times."""
        values, counts = self.total()
        total = counts.sum(axis=0, dtype=np.float64) + 0.5 * max(len(values), 1)
        seen = counts.sum(axis=1)
        keep = np.flatnonzero(seen >= LEAST)
        if len(keep) > KNOWN_MOST:
            keep = np.sort(keep[np.lexsort((values[keep], -seen[keep]))[:KNOWN_MOST]])
        return Table(values[keep], np.log((counts[keep] + 0.5) / total).astype(np.float32))


def fit(texts: list[str | None], langs: list[str]) -> Model:
    """Counts of words and character n-grams by language."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    words, grams = _Counts(max(len(names), 1)), {n: _Counts(max(len(names), 1)) for n in range(1, LONGEST + 1)}
    cut = np.cumsum([len(t or "") for t in texts]) // CHUNK_CHARS if texts else []
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cut)) + 1) if len(texts) else []:
        w = Words([texts[i] for i in part])
        own = np.repeat([number[langs[i]] for i in part], np.diff(w.first))
        # Occurrences of each distinct word in each language.
        pair, count = np.unique(w.inverse * len(names) + own, return_counts=True)
        word, language = pair // len(names), pair % len(names)
        words.add(w.hashes[word], language, count)
        for n, counts in grams.items():
            hashes, place = w.grams(word, n)
            counts.add(hashes, language[place], count[place])
    return Model(names, words.table(), {n: c.table() for n, c in grams.items()})


def identify(documents: DataFrame, wanted, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_LIMIT) -> DataFrame:
    """``key, lang_pred, score`` of every whole text.

    Learns from a ``samples.sample`` of ``limit`` rows at most with a language where
    ``wanted`` holds; each language's first rows come before all others, so a rare one
    is learned too.  Null and empty texts and texts without letters (combining marks
    alone are none) are ``und`` with score 0; so is everything if nothing can be
    learned.  Equal texts, repeated rows included, get equal results, and of equally
    likely languages the first by name is taken; a null key is kept; a text of any
    length is read whole, piece by piece; other columns, whatever their names, are not
    read.  An empty table gives an empty table.
    """
    model = samples.fitted(samples.sample(documents, documents.select(key, lang), lang, wanted, limit, key, text), fit)

    def fn(batches):
        for b in batches:
            names, score = model.predict_column(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return documents.select(key, text).mapInArrow(fn, f"`{key}` long, lang_pred string, score double")
