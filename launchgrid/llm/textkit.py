"""Words, word hashes and shingles of whole Arrow text columns in numpy.

Texts are UTF-8. A word is a run of bytes other than space and 0x09-0x0D; A-Z count as
a-z. Hashes are 64 bits. Work is done in pieces of about a megabyte, so memory follows
the number of words, not the square or a multiple of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_SHORT_SEED = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SEGMENT + 4096)
            for name, b in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up, cls.down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word in order, and words per text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    solid = ~_IS_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = offs[1:] > offs[:-1]
    begins, ends = offs[:-1][full], offs[1:][full] - 1
    first[begins] = solid[begins]
    last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(s), np.uint64)
    edges = np.unique(np.append(np.searchsorted(s, np.arange(0, n + SEGMENT, SEGMENT)), len(s)))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        a, b = s[i], e[j - 1]
        up, down = _Powers.upto(b - a + 1)
        h = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw[a:b]] * up[: b - a], dtype=np.uint64, out=h[1:])
        out[i:j] = mix((h[e[i:j] - a] - h[s[i:j] - a]) * down[s[i:j] - a])
    at = np.searchsorted(s, offs)
    return out, s, e, at[1:] - at[:-1]


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``size`` words.

    A text of fewer words, but one at least, has one: that of all its words.
    """
    n = len(hashes)
    runs = np.zeros(0, np.uint64)
    if n >= size:
        runs = hashes[: n - size + 1].copy()
        for k in range(1, size):
            runs = runs * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - size + 1 + k]
            runs ^= runs >> np.uint64(29)
        runs = mix(runs)
    at = 0
    for c in counts.tolist():
        if c >= size:
            yield np.unique(runs[at : at + c - size + 1])
        elif c:
            h = np.array([_SHORT_SEED + np.uint64(c)])
            for w in hashes[at : at + c]:
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)
        at += c


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one row at least)."""
    _, offs = utf8(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
