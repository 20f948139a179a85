"""Words and shingles of Arrow text batches as numpy arrays.

Everything works on the UTF-8 bytes of whole texts, a few megabytes at a time,
so the per-byte cost is a handful of vector operations and no Python loop.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of vector operations takes; a longer text is a round of its own.
ROUND = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=_U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers["up"]) < n:
        m = max(n, ROUND + 1)
        for key, base in (("up", _BASE), ("down", _BACK)):
            x = np.full(m, base)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def rounds(texts: pa.Array, most_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of at most ``most_rows`` consecutive rows with about ROUND bytes. Nulls are empty texts."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + ROUND, side="right")) - 1), lo + most_rows, len(texts))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    if len(data) > ROUND // 8:
        trimmed()


def trimmed() -> None:
    """Give free memory of this worker back, Arrow's and, where the C library can, its own: other steps run beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, down): the hash of bytes [s, e) is (P[e] - P[s]) * down[s]."""
    up, down = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * up[:-1], out=out[1:])
    return out, down


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(start, end, row, hash) of each word, a run of bytes that IN_WORD marks, A-Z taken as a-z."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, _U)
    inside = (IN_WORD if inside is None else inside)[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    p, down = prefix_hash(BYTE_CODE[LOWER[data]])
    return s, e, np.searchsorted(offs, s, side="right") - 1, mix((p[e] - p[s]) * down[s])


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of k words in a row of the table; rows with fewer words give none."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    n = len(h) - k + 1
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    out = np.zeros(len(at), _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + h[at + j]
    return at, mix(out)
