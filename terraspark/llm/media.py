"""AVI motion-JPEG columns: write, parse, decode and cut into timed clips.

``encode`` stores bytes without loss in the format's own unit, the quantised
coefficient: byte b becomes the AC coefficient 256 + b of a grey 8 x 8 block, 63 to
a block.  All such coefficients have 9 bits, so with a Huffman table of two codes
(``0`` for a 9-bit coefficient without zeros before it, ``10`` for the end of a
block) each takes ten bits, and frames are coded and decoded as whole arrays.

``parse`` walks the RIFF chunks (or the ``idx1`` index, if it is sound) of all segments
and ``decode`` reads any baseline frame, with the tables in the frame or, as usual in
motion-JPEG, the standard ones if there are none; only streams of the fixed-length kind
above take the array path.  Frames are decoded one by one, whatever the file's length.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

BLOCK = 64
PER_BLOCK = 63
BLOCKS_WIDE = 16
BLOCKS_HIGH = 16
FPS = 25
HISTOGRAM_BINS = 32
#: A shot begins where a difference is above the mean of those before by so many deviations.
CUT_DEVIATIONS = 3.0
CUT_LEAST = 0.25
_BITS = 1 + 10 * PER_BLOCK


def _zigzag() -> np.ndarray:
    """Place of each coefficient of the zigzag order in a block of rows."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([i * 8 + j for i, j in cells])


ZIGZAG = _zigzag()


def _cosines() -> np.ndarray:
    """Matrix from 64 coefficients (rows first) to 64 samples."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    c[:, 0] = 8**-0.5
    return np.kron(c, c).T.astype(np.float32)


_IDCT = _cosines()


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    tables = bytes([0x00, 1, *[0] * 15, 0]) + bytes([0x10, 1, 1, *[0] * 14, 0x09, 0x00])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, tables)
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def jpeg_frames(payload: np.ndarray, wide: int, high: int) -> list[bytes]:
    """The payload as frames of ``wide`` x ``high`` blocks, padded with zero bytes."""
    per_frame = wide * high * PER_BLOCK
    n = max(1, -(-len(payload) // per_frame))
    padded = np.zeros(n * per_frame, np.uint8)
    padded[: len(payload)] = payload
    head, out = _head(8 * wide, 8 * high), []
    for part in padded.reshape(n, per_frame):
        bits = np.zeros((wide * high, _BITS), np.uint8)
        each = np.zeros((wide * high, PER_BLOCK, 10), np.uint8)
        each[:, :, 1] = 1
        each[:, :, 2:] = np.unpackbits(part).reshape(-1, PER_BLOCK, 8)
        bits[:, 1:] = each.reshape(-1, _BITS - 1)
        flat = bits.ravel()
        flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
        scan = np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")
        out.append(head + scan + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames_: list[bytes], width: int, height: int, n_bytes: int, fps: int = FPS) -> bytes:
    """A RIFF AVI of motion-JPEG frames with an index; ``n_bytes``, the payload's length, goes to an INFO chunk."""
    largest = max(map(len, frames_), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames_), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames_), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", str(n_bytes).encode()))
    body, index, at = [], [], 4
    for f in frames_:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + lists + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def encode(payload: np.ndarray) -> bytes:
    """Bytes to an AVI; the frame is as small as the payload allows, 128 x 128 at most."""
    blocks = max(1, -(-len(payload) // PER_BLOCK))
    wide = min(BLOCKS_WIDE, blocks)
    high = min(BLOCKS_HIGH, -(-blocks // wide))
    return avi(jpeg_frames(payload, wide, high), 8 * wide, 8 * high, len(payload))


# ---------------------------------------------------------------- reading


@dataclass
class Movie:
    width: int
    height: int
    frame_us: int
    n_bytes: int | None
    frames: list[tuple[int, int]]  # (offset, length) in the file


def _chunks(data: memoryview, at: int, end: int):
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield bytes(data[at : at + 4]), at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def _pictures_in(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Offset and length of the video chunks in a list, also in its ``rec`` groups."""
    for name, a, n in _chunks(data, at, end):
        if name == b"LIST" and bytes(data[a : a + 4]) == b"rec ":
            yield from _pictures_in(data, a + 4, a + n)
        elif name[2:] in (b"dc", b"db"):
            yield a, n


def _indexed(data: memoryview, at: int, index: list[tuple]) -> list[tuple[int, int]]:
    """Video chunks by the index, whose offsets count from the ``movi`` list or from the file's begin; none if it is not sound."""
    named = [(name, off, n) for name, _, off, n in index if name[2:] in (b"dc", b"db")]
    for begin in (at, 0):
        if named and all(bytes(data[begin + off : begin + off + 4]) == name and begin + off + 8 + n <= len(data) for name, off, n in named):
            return [(begin + off + 8, n) for _, off, n in named]
    return []


def parse(blob: bytes) -> Movie:
    """Headers and frame places of an AVI, ``AVIX`` segments included; raises ValueError for anything else.

    A frame of length 0 repeats the one before.
    """
    data = memoryview(blob)
    if len(data) < 12 or bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("no RIFF AVI")
    movie, movis, index, at = Movie(0, 0, 1_000_000 // FPS, None, []), [], [], 0
    while at + 12 <= len(data) and bytes(data[at : at + 4]) == b"RIFF":
        size = struct.unpack_from("<I", data, at + 4)[0]
        # A length of 0 or beyond the end: the file was not closed, or is broken off.
        end = min(at + 8 + size, len(data)) if size else len(data)
        todo = list(_chunks(data, at + 12, end))
        while todo:
            name, a, n = todo.pop(0)
            if name == b"LIST":
                kind = bytes(data[a : a + 4])
                if kind == b"movi":
                    movis.append((a, n))
                elif kind in (b"hdrl", b"strl", b"INFO"):
                    todo += _chunks(data, a + 4, a + n)
            elif name == b"avih" and n >= 40:
                movie.frame_us = struct.unpack_from("<I", data, a)[0] or movie.frame_us
                movie.width, movie.height = struct.unpack_from("<II", data, a + 32)
            elif name == b"ICMT":
                text = bytes(data[a : a + n]).strip(b"\0 ")
                movie.n_bytes = int(text) if text.isdigit() else None
            elif name == b"idx1" and not index:
                index = [struct.unpack_from("<4sIII", data, p) for p in range(a, a + n - 15, 16)]
        at = end + end % 2
    if not movis:
        raise ValueError("no movi list")
    for k, (a, n) in enumerate(movis):
        movie.frames += (_indexed(data, a, index) if k == 0 else []) or list(_pictures_in(data, a + 4, a + n))
    return movie


@dataclass
class Frame:
    width: int
    height: int
    components: list[dict]
    #: Quantised coefficients in zigzag order of each component: (block rows, block columns, 64).
    coefficients: list[np.ndarray]

    def luma(self) -> np.ndarray:
        """Samples 0-255 of the first component."""
        c, q = self.coefficients[0], self.components[0]["quant"]
        rows, columns, _ = c.shape
        natural = np.empty((rows * columns, 64), np.float32)
        natural[:, ZIGZAG] = c.reshape(-1, 64) * q
        samples = np.clip(np.rint(natural @ _IDCT + 128), 0, 255).astype(np.uint8)
        return samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)[: self.height, : self.width]


def _standard(lengths: str, first: str) -> tuple[bytes, bytes]:
    """Counts and symbols of an AC table: the named symbols, then all others in order."""
    head = bytes.fromhex(first)
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return bytes.fromhex(lengths), head + bytes(sorted(set(every) - set(head)))


#: The standard tables of baseline JPEG, which motion-JPEG frames leave out (class and number, counts, symbols).
STANDARD = {
    0x00: (bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))),
    0x01: (bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))),
    0x10: _standard("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    0x11: _standard("00020102040403040705040400010277", "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}


@lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come, the length of the code at their head times 256 plus its symbol; 0 where there is none."""
    out, at = np.zeros(1 << 16, np.int32), 0
    code = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


class _Bits:
    """Reads a scan from its head: a few bytes at a time are held as one small number."""

    def __init__(self, scan: bytes):
        self.scan, self.at, self.held, self.n = scan + bytes(16), 0, 0, 0
        self.end = 8 * len(scan)

    def _fill(self) -> None:
        if 8 * self.at - self.n > self.end:
            raise ValueError("the scan is too short")
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(self.scan[self.at : self.at + 8].ljust(8, b"\0"), "big")
        self.n += 64
        self.at += 8

    def symbol(self, codes: list[int]) -> int:
        if self.n < 16:
            self._fill()
        found = codes[(self.held >> (self.n - 16)) & 0xFFFF]
        if not found:
            raise ValueError("no such code")
        self.n -= found >> 8
        return found & 0xFF

    def signed(self, n: int) -> int:
        if not n:
            return 0
        if self.n < n:
            self._fill()
        self.n -= n
        v = (self.held >> self.n) & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1

    def check(self) -> None:
        """ValueError if more was read than there is."""
        if 8 * self.at - self.n > self.end:
            raise ValueError("the scan is too short")


def decode(jpeg: bytes | memoryview) -> Frame:
    """A baseline JPEG's coefficients; ValueError for other processes or broken data."""
    data, at = bytes(jpeg), 2
    quant, tables, restart, frame = {}, dict(STANDARD), 0, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        if data[at + 1] == 0xFF:
            # Fill bytes may stand before a marker.
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = Frame(width, height, [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)], [])
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            for i in range(body[0]):
                c = next(c for c in frame.components if c["id"] == body[1 + 2 * i])
                c |= {"dc": tables[body[2 + 2 * i] >> 4], "ac": tables[0x10 | body[2 + 2 * i] & 15], "quant": quant[c["q"]]}
            end = data.rfind(b"\xff\xd9")
            _scan(frame, data[at : end if end >= at else len(data)], restart)
            return frame
    raise ValueError("no scan")


#: The two tables of ``encode``'s frames.
_OWN = ((bytes([1, *[0] * 15]), b"\x00"), (bytes([1, 1, *[0] * 14]), b"\x09\x00"))


def _scan(frame: Frame, scan: bytes, restart: int) -> None:
    parts = frame.components
    if len(parts) == 1:
        parts[0] |= {"h": 1, "v": 1}
    h, v = max(c["h"] for c in parts), max(c["v"] for c in parts)
    across, down = -(-frame.width // (8 * h)), -(-frame.height // (8 * v))
    frame.coefficients = [np.zeros((down * c["v"], across * c["h"], 64), np.int32) for c in parts]
    only = parts[0]
    if len(parts) == 1 and not restart and (only["dc"], only["ac"]) == _OWN:
        bits = np.unpackbits(np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8))
        n = across * down * _BITS
        if len(bits) >= n:
            each = bits[:n].reshape(-1, _BITS)
            coded = each[:, 1:].reshape(-1, PER_BLOCK, 10)
            # All blocks full of positive nine-bit coefficients: the whole scan is one array.
            if not each[:, 0].any() and not coded[:, :, 0].any() and coded[:, :, 1].all():
                low = np.packbits(np.ascontiguousarray(coded[:, :, 2:])).reshape(-1, PER_BLOCK)
                frame.coefficients[0].reshape(-1, 64)[:, 1:] = low.astype(np.int32) + 256
                return
    marks = [m for m in np.flatnonzero(np.frombuffer(scan, np.uint8)[:-1] == 0xFF).tolist() if 0xD0 <= scan[m + 1] <= 0xD7] if len(scan) > 1 else []
    pieces = [scan[a:b] for a, b in zip([0, *(m + 2 for m in marks)], [*marks, len(scan)], strict=True)]
    codes = [(_huffman(*c["dc"]), _huffman(*c["ac"])) for c in parts]
    unit = 0
    for piece in pieces:
        bits, before = _Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        symbol, signed = bits.symbol, bits.signed
        for _ in range(min(restart or across * down, across * down - unit)):
            y, x = divmod(unit, across)
            for k, c in enumerate(parts):
                dc, ac = codes[k]
                for i in range(c["v"]):
                    for j in range(c["h"]):
                        before[k] += signed(symbol(dc))
                        values, at = [before[k]] + [0] * 63, 1
                        while at < 64:
                            s = symbol(ac)
                            n = s & 15
                            if not n:
                                if s != 0xF0:
                                    break
                                at += 16
                                continue
                            at += s >> 4
                            if at > 63:
                                raise ValueError("too many coefficients")
                            values[at] = signed(n)
                            at += 1
                        frame.coefficients[k][y * c["v"] + i, x * c["h"] + j] = values
            unit += 1
        bits.check()


def pictures(blob: bytes, movie: Movie) -> Iterator[Frame | None]:
    """The decoded frames one by one; None where a frame is empty or can't be decoded."""
    data = memoryview(blob)
    for a, n in movie.frames:
        try:
            yield decode(data[a : a + n]) if n else None
        except (ValueError, KeyError, StopIteration, IndexError, struct.error):
            yield None


def read(blob: bytes) -> tuple[Movie, list[Frame]]:
    """An AVI's headers and decoded frames."""
    movie, data = parse(blob), memoryview(blob)
    return movie, [decode(data[a : a + n]) for a, n in movie.frames]


def stored_in(frame: Frame) -> bytes:
    """The bytes that ``encode`` stored in a frame, padding included."""
    return (frame.coefficients[0][:, :, 1:].ravel() - 256).astype(np.uint8).tobytes()


def payload_of(movie: Movie, frames_: list[Frame]) -> bytes:
    """The bytes that ``encode`` stored in these frames."""
    return b"".join(map(stored_in, frames_))[: movie.n_bytes]


def feature(movie: Movie, hist: np.ndarray) -> str:
    """Geometry, length, shots and mean luma of a video as text, from its frames' histograms."""
    luma = float((hist.mean(axis=0) * (np.arange(HISTOGRAM_BINS) + 0.5)).sum() * 256 / HISTOGRAM_BINS)
    return f"{movie.width}x{movie.height} frames={len(hist)} ms={len(hist) * movie.frame_us // 1000} shots={','.join(map(str, shots(hist)))} luma={luma:.2f}"


def store_texts(documents: DataFrame, then: Callable[[int | None, int, bytes], dict], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, padded, as an AVI; ``then(key, unpadded bytes, avi)`` gives the row.

    A null text counts as empty; the videos of equal texts are equal; repeated rows
    give repeated rows; an empty table gives an empty table.
    """

    def fn(batches):
        for b in batches:
            raw, offsets = K.texts_of(b.column(1))
            ids = b.column(0).to_pylist()
            for begin in range(0, len(ids), 256):
                rows = [then(ids[i], int(offsets[i + 1] - offsets[i]), encode(padded(raw[offsets[i] : offsets[i + 1]]))) for i in range(begin, min(begin + 256, len(ids)))]
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    empty = documents.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(empty.schema)
    return documents.select(key, text).mapInArrow(fn, schema)


def histogram(frame: Frame) -> np.ndarray:
    """Shares of luma values in 32 bins."""
    x = frame.luma()
    return np.bincount(x.ravel() >> 3, minlength=HISTOGRAM_BINS) / x.size


def looks(blob: bytes, movie: Movie) -> tuple[np.ndarray, np.ndarray]:
    """Histogram and mean luma of each frame; an empty or broken frame looks as the one before, one at the head as the first good one."""
    hist, luma, early = [], [], 0
    for f in pictures(blob, movie):
        if f is not None:
            hist.append(histogram(f))
            luma.append(float(f.luma().mean()))
        elif hist:
            hist.append(hist[-1])
            luma.append(luma[-1])
        else:
            early += 1
    if not hist:
        return np.zeros((0, HISTOGRAM_BINS)), np.zeros(0)
    return np.array(hist[:1] * early + hist), np.array(luma[:1] * early + luma)


def shots(hist: np.ndarray) -> list[int]:
    """First frames of shots: a difference is a cut if it is large and far above those since the last cut."""
    starts, seen = [0], []
    for i, d in enumerate(np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2, 1):
        if d >= CUT_LEAST and (not seen or d > np.mean(seen) + CUT_DEVIATIONS * np.std(seen)):
            starts.append(i)
            seen = []
        else:
            seen.append(d)
    return starts if len(hist) else []


def clips(media: DataFrame, key: str = "media_id", blob: str = "avi") -> DataFrame:
    """Timed clip rows ``key, clip, first_frame, n_frames, start_ms, end_ms, mean_luma`` of AVI blobs.

    Null blobs, blobs that are no AVI and AVIs without any frame that can be decoded give
    no rows.  Other broken frames, and empty ones, stand for the frame before (those at
    the head for the first good one), so that times stay right.  Null keys are kept;
    repeated rows give repeated clips; other columns are not read; an empty table gives
    an empty table.
    """
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())

    def fn(batches):
        for b in batches:
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not data.is_valid:
                    continue
                raw = data.as_buffer().to_pybytes()
                try:
                    movie = parse(raw)
                except (ValueError, struct.error):
                    continue
                hist, luma = looks(raw, movie)
                cuts = shots(hist)
                for i, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(hist)], strict=True) if cuts else ()):
                    rows.append((k, i, s, e - s, s * movie.frame_us // 1000, e * movie.frame_us // 1000, float(luma[s:e].mean())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "clip", "first_frame", "n_frames", "start_ms", "end_ms", "mean_luma"])

    return media.select(key, blob).mapInArrow(fn, f"`{key}` long, clip int, first_frame int, n_frames int, start_ms long, end_ms long, mean_luma double")


def padded(raw: np.ndarray) -> np.ndarray:
    """Bytes with zeros up to a positive multiple of 64."""
    out = np.zeros(max(1, -(-len(raw) // BLOCK)) * BLOCK, np.uint8)
    out[: len(raw)] = raw
    return out
