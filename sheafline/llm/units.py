"""Vectorised text units: byte and word codes, rolling hashes and content-chosen anchors (NumPy only).

A *block* is a run of documents laid out end to end, as Arrow stores them. Hashes are polynomials modulo 2**64 over
scrambled unit codes with a final mix, so any range of a block is hashed from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: White-space separators 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POW = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=U64)
    return _POW[0][:n], _POW[1][:n]


class Rolling:
    """Hash of any range of a code sequence."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes * up[:n], dtype=U64, out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def text_blocks(column: pa.Array, limit: int = 1 << 21, max_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of a string column, about ``limit`` bytes
    and at most ``max_rows`` rows each.

    Null texts are empty. A longer single text is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + max_rows)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of each document's words) of maximal runs of bytes that aren't separators."""
    word = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, word
    here = np.empty(len(data) + 1, bool)
    here[-1], here[:-1] = False, word
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_CODES[data]).at(starts, ends)


def sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    size, cur = 1, x
    while size * 2 <= width:
        cur = fold(cur[:-size], cur[size:])
        size *= 2
    return cur if size == width else fold(cur[: len(cur) - (width - size)], cur[width - size :])


def anchors(codes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Positions chosen by content so that equal windows of ``window`` units choose equal relative positions.

    In each window inside one document the ``gram``-unit runs with the least hash are chosen, all of them on ties; so
    each occurrence of a repeated window holds an anchor with the same hash at the same place in the window. ``key`` is
    the gram's hash, ``context`` the hash of all units that a window through the anchor can reach: ``left`` before and
    ``right`` from the anchor, cut at the document's ends.
    """
    n, w = len(codes), window - gram + 1
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("at", "doc", "key", "context", "left", "right")}
    roll = Rolling(codes)
    h = roll.grams(gram)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    low = sliding(h, w, np.minimum)
    low[doc_end[: n - window + 1] - np.arange(n - window + 1) < window] = 0
    pad = np.zeros(w - 1, U64)
    best = sliding(np.concatenate([pad, low, pad]), w, np.maximum)
    at = np.flatnonzero((best == h) & (best > 0))
    doc = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(at - offsets[doc], window - gram)
    right = np.minimum(offsets[doc + 1] - at, window)
    context = mix(roll.at(at - left, at + right) ^ (left * 65536 + right).astype(U64))
    return {"at": at, "doc": doc, "key": h[at].view(np.int64), "context": context.view(np.int64), "left": left, "right": right}


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the units of [0, n) inside any of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
