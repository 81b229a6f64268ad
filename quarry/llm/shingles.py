"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z are
lower-cased.  All work is done on the raw UTF-8 bytes: word boundaries come from
a byte table, word hashes from prefix sums of a polynomial over random byte
values (mod 2**64), shingle hashes from a multiply-add over five word hashes.
Texts are taken in pieces of bounded size cut at white space, and their prefix sums
in blocks of words, so memory does not follow the longest text (only its word hashes,
eight bytes a word, are held).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
PIECE_BYTES = 1 << 21
#: Bytes whose prefix sums are held at once; a longer word takes as much as it needs.
BLOCK_BYTES = 1 << 17

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


FOLDED_VALUE = _BYTE_VALUE
#: Byte values under which capitals differ from small letters.
CASED_VALUE = _BYTE_VALUE.copy()
CASED_VALUE[ord("A") : ord("Z") + 1] = _rng.integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        have = np.multiply.accumulate(table)
        if n <= BLOCK_BYTES:
            _powers[base] = have
    return have


def run_hashes(values: Callable[[int, int], np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials over the values of runs that follow each other; ``values`` gives those between two places.

    Blocks of runs are taken one by one, as the polynomial of a run does not depend on its place.
    """
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, "right")))
        first, last = starts[k:stop] - lo, ends[k:stop] - lo
        n = int(last[-1])
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values(lo, lo + n) * _power_table(_BASE, n)[:n], out=sums[1:])
        out[k:stop] = (sums[last] - sums[first]) * _power_table(_INVERSE, n)[first]
        k = stop
    return out


def piece_words(data: np.ndarray, cuts: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of ``data`` with the start and end byte of each; words end at ``cuts`` too."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] |= solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] |= solid[inner - 1]
    ends = np.flatnonzero(last) + 1
    raw = run_hashes(lambda a, b: values[data[a:b]], starts, ends)
    hashes = mix64(raw + (ends - starts).astype(np.uint64) * _STEP)
    return hashes, starts, ends


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string or binary array; nulls read as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return data, at


def space_cuts(data: np.ndarray, lo: int, hi: int, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Pieces of about ``size`` bytes of a long text, cut at white space."""
    while lo < hi:
        stop = min(hi, lo + size)
        while stop < hi:
            gap = np.flatnonzero(_SPACE[data[stop : stop + 4096]])
            if len(gap):
                stop = min(hi, stop + int(gap[0]))
                break
            stop = min(hi, stop + 4096)
        yield lo, stop
        lo = stop


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, n+1 word offsets) for runs of whole rows of ``column``."""
    data, at = string_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
        lo, hi = int(at[row]), int(at[end])
        if hi - lo <= PIECE_BYTES:
            hashes, starts, _ = piece_words(data[lo:hi], at[row : end + 1] - lo)
            yield row, hashes, np.searchsorted(starts, at[row : end + 1] - lo)
        else:
            hashes = np.concatenate([piece_words(data[a:b], np.empty(0, np.int64))[0] for a, b in space_cuts(data, lo, hi)])
            yield row, hashes, np.array([0, len(hashes)])
        row = end


def window_hashes(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``width`` words (as many as words, less width - 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = words[:n] * _STEP
    for k in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(_BASE) + words[k : n + k]
    return mix64(acc)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence shorter than a shingle; none for no words."""
    return window_hashes(words, len(words)) ^ np.uint64(len(words)) if len(words) else words


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of ``column``."""
    for first, words, offsets in word_hashes(column):
        windows = window_hashes(words)
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= SHINGLE_WORDS:
                found = np.sort(windows[a : b - SHINGLE_WORDS + 1])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield first + i, found[keep]
            else:
                yield first + i, whole_hash(words[a:b])
