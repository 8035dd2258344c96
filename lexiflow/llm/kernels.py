"""Vectorised text helpers for Arrow batches: words, hashes, windows, minimisers.

Everything works on slices of whole rows: the UTF-8 bytes of the rows of one
slice lie in one buffer, and numpy passes run over it.  A word is a maximal run
of bytes outside ``\\x20 \\x09-\\x0D`` (the continuation bytes of UTF-8 are never
among these, so this equals the same rule on characters).  Polynomial hashes
are taken modulo 2**64 over a fixed random byte table and then mixed; a use
that must be exact compares the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: fixed pseudo-random value of each byte
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256).astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection): spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


#: BASE**i and BASE**-i for i < n: one table, remade when a longer one is asked for; beyond KEEP it isn't kept
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
KEEP = (4 << 20) + (1 << 16)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (or more)."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(1 << 16, min(n + n // 4, max(n, KEEP)))
    out = []
    with np.errstate(over="ignore"):
        for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, out=p))
    if size <= KEEP:
        _POWERS[:] = out
    return out[0], out[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = BASE**i * hash(buf[i:j])."""
    p, _ = powers(len(buf) + 1)
    s = np.zeros(len(buf) + 1, np.uint64)
    v = _BYTE[buf]
    v *= p[: len(buf)]
    np.cumsum(v, out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of buf[start:end] for each pair."""
    _, inv = powers(len(s))
    return mix((s[end] - s[start]) * inv[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and the offset of each row (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    o = np.frombuffer(off, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        ok = np.asarray(column.is_valid())
        size = np.where(ok, np.diff(o), 0)
        if size.sum() != o[-1] - o[0]:
            keep = np.repeat(ok, np.diff(o))
            raw = raw[o[0]: o[-1]][keep]
            return raw, np.concatenate([[0], np.cumsum(size)])
    return raw[o[0]: o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch with at most ``most`` bytes of text (one row at least)."""
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the first word of each row (rows + 1).

    ``apart``: which of the 256 bytes separate words.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~apart[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True                     # a row starts here (or the buffer ends)
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[buf]


def shingle_hash(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (len - k + 1 values)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word_hash[:n].copy()
    for j in range(1, k):
        h *= BASE
        h += word_hash[j: j + n]
    return mix(h)


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values (len - w + 1 results)."""
    if len(v) < w:
        return v[:0]
    m, size = v, 1
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as sorted maximal runs (touching ones merge)."""
    if len(start) == 0:
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], e[last]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] values of each, one after another."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first - start, count)
