"""Words, word shingles and their hashes over whole Arrow batches of text, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_MIX = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)]
#: Polynomials modulo a power of two collide on some texts of a thousand bytes and more, whatever their base; words from this length on have a hash of another kind.
LONG_WORD = 256
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def pieces(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(raw: np.ndarray, at: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, ends)``: the first and last byte of every word; bytes that are ``apart`` part words, and no word goes over the end of a text."""
    n = len(raw)
    inside = ~apart[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the hash of every word; the words of text i are first[i]:first[i+1]."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    s, e = spans(raw, at)
    return hashed(raw, s, e, lower), np.searchsorted(s, at)


def hashed(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of every word of ``spans``."""
    n = len(raw)
    up, down = _power(n + 1)
    total = np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[:n])
    h = total[e]
    h[s > 0] -= total[s[s > 0] - 1]
    h = mixed(h * down[s] + (e - s).astype(np.uint64) * _MIX[4])
    for i in np.flatnonzero(e - s + 1 >= LONG_WORD):
        word = raw[s[i] : e[i] + 1]
        h[i] = xxhash.xxh3_64_intdigest((_LOWER[word] if lower else word).tobytes())
    return h


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, in order. A text with fewer words gives its whole sequence as one, an empty text none."""
    n = len(h)
    full = np.zeros(0, np.uint64)
    if n >= size:
        full = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            full = (full ^ (full >> np.uint64(31))) * _MIX[2] + h[k : n - size + 1 + k] * _MIX[3]
        full = mixed(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = (x ^ (x >> np.uint64(31))) * _MIX[0] + w * _MIX[1]
            out.append(mixed(np.array([x], np.uint64)))
        else:
            out.append(full[:0])
    return out


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of every row, in the order of the rows."""
    with np.errstate(over="ignore"):
        for _, raw, at in pieces(texts):
            yield from shingles(*words(raw, at), size)
