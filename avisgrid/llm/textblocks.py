"""Texts of Arrow batches as numpy arrays: code points, piece boundaries, piece hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text, or one row: start, stop, bytes, offsets.

    Null counts as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    if texts.null_count:
        texts = pa.compute.fill_null(texts, b"")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        lo, hi = int(offsets[start]), int(offsets[stop])
        raw = data[lo:hi].to_pybytes() if hi > lo else b""
        yield start, stop, raw, offsets[start : stop + 1] - lo
        start = stop


def code_points(raw: bytes, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The decoded text, its code points, and the offsets in code points."""
    text = raw.decode("utf-8")
    if len(text) == len(raw):
        return text, np.frombuffer(raw, np.uint8).astype(np.uint32), offsets
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
    return text, points, lead[offsets]


class Powers:
    """Powers of the hash base and of its inverse, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _ODD), ("down", _ODD_INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))


_POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, from one prefix sum of the polynomial."""
    _POWERS.need(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(points)], out=total[1:])
    h = (total[stops] - total[starts]) * _POWERS.down[starts]
    return mixed(h ^ ((stops - starts).astype(np.uint64) << np.uint64(48)))


def fold_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    upper = (points >= 65) & (points <= 90)
    return points + upper.astype(points.dtype) * 32


def blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def words(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept code points inside one document: starts, stops, document of each."""
    n = len(keep)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = np.zeros(n, bool), np.ones(n, bool)
    begins[0] = True
    begins[1:] = ~keep[:-1] | first[1:n]
    ends[:-1] = ~keep[1:] | first[1:n]
    starts = np.flatnonzero(keep & begins)
    stops = np.flatnonzero(keep & ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def gathered(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [begin, begin + length)."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(begin - (ends - length), length)


class Folder:
    """Kept characters in lower case, others as 0; one code point stays one code point."""

    def __init__(self, keep) -> None:
        self.keep = keep
        self.table = np.full(0x110000, -1, np.int32)
        self._fill(range(128))

    def _fill(self, points) -> None:
        for p in points:
            c = chr(p)
            low = c.lower()
            self.table[p] = 0 if not self.keep(c) else ord(low) if len(low) == 1 else p

    def fold(self, points: np.ndarray) -> np.ndarray:
        folded = self.table[points]
        if len(folded) and folded.min() < 0:
            self._fill(np.unique(points[folded < 0]).tolist())
            folded = self.table[points]
        return folded


def word_hashes(
    folder: Folder, raw: bytes, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the folded words of all texts; starts, stops (code points) and text of each."""
    _, points, offsets = code_points(raw, offsets)
    folded = folder.fold(points)
    starts, stops, row = words(folded > 0, offsets)
    return span_hashes(folded, starts, stops), starts, stops, row
