"""Words of whole Arrow string columns, hashed without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes looked at in one step; a longer run without any break is looked at whole.
STEP = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the two definitions in use: all but ASCII white space, and ASCII
#: letters (after lower-casing) and digits with everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP + 1)
        out = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's begin (one more than
    rows). A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _cuts(data: np.ndarray, word: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Where the buffer can be cut without cutting a word."""
    cuts, n = [0], len(data)
    while cuts[-1] < n:
        low, high = cuts[-1], min(n, cuts[-1] + STEP)
        if high < n:
            inside = np.flatnonzero(~word[data[low:high]])
            row = offsets[np.searchsorted(offsets, high, "right") - 1]
            best = max(low + int(inside[-1]) if len(inside) else low, int(row))
            if best <= low:  # one word of more than STEP bytes
                beyond = np.flatnonzero(~word[data[high:]])
                after = offsets[np.searchsorted(offsets, high, "left")]
                best = min(high + int(beyond[0]) if len(beyond) else n, int(after))
            high = best
        cuts.append(high)
    return cuts


def words(column: pa.Array, word: np.ndarray, places: bool = False, prefix: int = 0):
    """64-bit hashes of the lower-cased words of all rows, in order, and where each
    row's begin; with ``places`` also each word's first byte and the byte behind
    it, in the column's buffer; with ``prefix`` a hash of each word's first so many
    bytes instead."""
    data, offsets = bytes_of(column)
    hashes, firsts, lasts, heads = [], [], [], []
    cuts = _cuts(data, word[LOWER], offsets)
    for low, high in zip(cuts, cuts[1:]):
        part = LOWER[data[low:high]]
        is_word = word[part]
        breaks = np.zeros(high - low + 1, bool)
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low
        breaks[inner] = breaks[0] = breaks[-1] = True
        first = is_word.copy()
        first[1:] &= breaks[1:-1] | ~is_word[:-1]
        last = is_word.copy()
        last[:-1] &= breaks[1:-1] | ~is_word[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: high - low], out=sums[1:])
        hashes.append(mix((sums[b] - sums[a]) * down[a]))
        if prefix:
            heads.append(mix((sums[np.minimum(b, a + prefix)] - sums[a]) * down[a]))
        firsts.append(a + low)
        lasts.append(b + low)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    a = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    begin = np.searchsorted(a, offsets)
    if prefix:
        return h, begin, np.concatenate(heads) if heads else h
    if places:
        return h, begin, a, (np.concatenate(lasts) if lasts else np.zeros(0, np.int64))
    return h, begin


def word_hash(text: str, word: np.ndarray) -> np.ndarray:
    return words(pa.array([text]), word)[0]


_STEPS = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one row; a row with fewer words is
    one run, a row without words has none."""
    if not len(h):
        return h
    if len(h) < width:
        out = np.uint64(len(h))
        with np.errstate(over="ignore"):
            for x in h:
                out = mix(np.array([out * _STEPS[0] + x]))[0]
        return np.array([out], np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out * _STEPS[j % len(_STEPS)] + h[j : j + n]) if j else h[:n].copy()
    return out
