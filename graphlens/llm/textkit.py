"""Vectorised byte-level text primitives over Arrow string columns.

Texts of a batch are treated as one byte array with offsets; nothing crosses
a text's end. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step handles (a longer text is a step of its own).
CHUNK = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(-(-n // _STEPS) * _STEPS, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, or of one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' byte ranges, and for each text the index of its first word, with the total last."""
    n = len(buf)
    solid = np.zeros(n + 2, bool)
    solid[1 : n + 1] = ~SPACE[buf]
    fresh = np.zeros(n + 1, bool)
    fresh[offs] = True
    starts = np.flatnonzero(solid[1 : n + 1] & (~solid[:n] | fresh[:n]))
    ends = np.flatnonzero(solid[1 : n + 1] & (~solid[2:] | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(buf: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums of a polynomial rolling hash of the bytes."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(table[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges from prefix(): equal bytes, equal hashes."""
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z lower-cased."""
    return spans(prefix(buf, _BYTE_LOWER), starts, ends)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word index, first): n-word shingles in order. A text of fewer words has its whole sequence as one."""
    total, count = len(hashes), np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    out = np.zeros(0, U64)
    at = np.zeros(0, np.int64)
    if total >= n:
        size = total - n + 1
        out = np.zeros(size, U64)
        for j in range(n):
            out += hashes[j : j + size] * U64((0xA0761D6478BD642F * (2 * j + 3) ** 5 | 1) & (2**64 - 1))
        at = np.flatnonzero(text[:size] == text[n - 1 :])
        out = mix(out[at])
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        extra = np.array([short(hashes[first[i] : first[i] + count[i]]) for i in few], U64)
        out, at = np.concatenate([out, extra]), np.concatenate([at, first[few]])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at, np.searchsorted(at, first)


def short(hashes: np.ndarray) -> int:
    x = len(hashes) * 0x8EBC6AF09C88C6E3
    for h in hashes.tolist():
        x = (x * 0x589965CC75374CC3 + h) & (2**64 - 1)
        x ^= x >> 29
    return x
