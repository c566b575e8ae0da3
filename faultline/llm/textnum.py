"""Words of many texts at once, as numpy arrays over one byte buffer.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 after A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[[i for i in range(128) if not chr(i).isalpha()]] = True

_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)


@dataclass
class Words:
    """Words of several texts: ``buf`` has each word followed by one space.

    ``start`` and ``end`` are byte positions in ``buf``; text i has the words
    ``first[i]:first[i + 1]``.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column, null as empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def runs(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``most``; a larger text stands alone."""
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def words(texts: list[bytes], letters_only: bool = False, lower: bool = True) -> Words:
    """With ``letters_only``, ASCII characters other than letters part words too; without ``lower``, A-Z stay."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    raw = _LOWER[raw] if lower else raw
    space = (_NO_LETTER if letters_only else _SPACE)[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]  # one space after each word stays
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])  # where each text starts in raw
    raw = np.where(space, np.uint8(32), raw)
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    buf = raw[keep]
    is_end = buf == 32
    end = np.flatnonzero(is_end)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    first = np.searchsorted(start, kept_before[edges])
    return Words(buf, start.astype(np.int64), end.astype(np.int64), first)


def _at(buf: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian integers at every byte of ``buf`` (padded by 8 bytes)."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - width + 1,), kind, buf.data, strides=(1,))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for each pair."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        data = buf.tobytes()
        out[long] = [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    short = np.flatnonzero(size < 32)
    if not len(short):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    order = short[np.argsort(size[short], kind="stable")]
    n = size[order]
    at = start[order].copy()
    with np.errstate(over="ignore"):
        h = np.full(len(order), np.uint64(seed) + _P5) + n.astype(np.uint64)
        w8, w4 = _at(padded, "<u8"), _at(padded, "<u4")
        for lane in range(3):
            k = np.searchsorted(n, 8 * (lane + 1))
            if k == len(n):
                break
            x = _rotl(w8[at[k:]] * _P2, 31) * _P1
            h[k:] = _rotl(h[k:] ^ x, 27) * _P1 + _P4
            at[k:] += 8
        rest = n % 8
        i = np.flatnonzero(rest >= 4)
        if len(i):
            h[i] = _rotl(h[i] ^ (w4[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[i] += 4
        rest = rest % 4
        for b in range(1, 4):
            i = np.flatnonzero(rest >= b)
            if len(i):
                h[i] = _rotl(h[i] ^ (padded[at[i]].astype(np.uint64) * _P5), 11) * _P1
                at[i] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    out[order] = h
    return out


def shingle_ends(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, start, end): runs of k words of each text, or its whole sequence if shorter.

    Text i has the shingles ``first[i]:first[i + 1]``; without words it has none.
    """
    count = np.diff(w.first)
    of = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(of)])
    at = np.repeat(w.first[:-1] - first[:-1], of) + np.arange(first[-1])
    last = np.minimum(at + k - 1, np.repeat(w.first[1:], of) - 1)
    return first, w.start[at], w.end[last]
