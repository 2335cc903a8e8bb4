"""Words of Arrow text columns as 64-bit hashes, in whole numpy arrays.

A batch's texts are read straight from Arrow's buffer in slices that fit a processor's cache (one long text may be a
larger slice of its own), so memory follows the slice, not the table. Two words get equal hashes only by a 64-bit accident.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_class(delimiters: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: those outside the given ranges."""
    out = np.ones(256, dtype=bool)
    for lo, hi in delimiters:
        out[lo : hi + 1] = False
    return out


#: Words end at ASCII white space.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words are letters, digits and everything beyond ASCII (for lower-cased text).
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[_LOWER]
_pow, _inv = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1)
        _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
        _inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])
    return _pow[:n], _inv[:n]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows with about `most` bytes; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word (A-Z count as a-z), and for each text the number of words before it."""
    inside = is_word[_LOWER[raw]]
    edge = np.empty(len(raw) + 1, bool)  # a word may begin or end before byte i
    if len(raw):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
    else:
        edge[:] = False
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    joint = cut[inside[cut] & inside[cut - 1]]  # two texts' words meet here
    starts = np.flatnonzero(edge[:-1] & inside) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(edge[1:] & inside) + 1 if len(raw) else np.zeros(0, np.int64)
    if len(joint):
        joint = np.unique(joint)
        starts = np.sort(np.concatenate([starts, joint]))
        ends = np.sort(np.concatenate([ends, joint]))
    return starts, ends, np.searchsorted(starts, at)


def word_table(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of every word, and for each text the number of words before it (one more than texts)."""
    starts, ends, first = word_spans(raw, at, is_word)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends, first


def word_hashes(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and for each text the number of words before it."""
    hashes, _, _, first = word_table(raw, at, is_word)
    return hashes, first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of words i..i+n-1 for every i that has so many; the length is part of it."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xA0761D6478BD642F) + words[k : len(words) - n + 1 + k]
    return mixed(out)
