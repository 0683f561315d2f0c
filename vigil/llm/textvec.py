"""Vectorised word and shingle hashing of Arrow text columns.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z folded.  Word hashes are
polynomial hashes taken from prefix sums over the raw UTF-8 bytes; shingle
hashes mix the word hashes of five neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: bytes worked on at a time; a longer text is worked on alone
SLICE_BYTES = 4 << 20
_ODD = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += U(32)
    return mix(fold + U(0x1234567))


_BYTE = _byte_table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PLACE = mix(np.arange(1, 9, dtype=np.uint64)) | U(1)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n, grown on demand."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        grown = []
        for base in (_ODD, inverse):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
            grown.append(p)
        _powers = tuple(grown)
    return _powers


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    column = pa.array(column.to_pylist(), pa.large_string()) if not isinstance(column, pa.Array) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a single longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row) of the rows between ``offsets``."""
    rows = len(offsets) - 1
    base, end = int(offsets[0]), int(offsets[-1])
    if end == base:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    raw = data[base:end]
    off = offsets - base
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = off[:-1][off[:-1] < len(raw)]
    first[cut] = solid[cut]                       # a row starts a word of its own
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(raw) + 1)
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=run[1:])
    words = mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.diff(np.searchsorted(starts, off))


def shingle_sets(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingle hashes of each row, joined; set sizes).

    Fewer than k words make one shingle of the whole row, no words none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    full = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        full += padded[j:j + n] * _PLACE[j]
    full = mix(full)
    stop = np.cumsum(counts)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for r in np.flatnonzero(counts):
        a, b = int(stop[r] - counts[r]), int(stop[r])
        if b - a >= k:
            s = full[a:b - k + 1]
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = mix((words[a:b] * _PLACE[:b - a]).sum(keepdims=True, dtype=np.uint64)
                    + U(0xABCD) * U(b - a))
        sizes[r] = len(s)
        parts.append(s)
    return np.concatenate(parts), sizes


def set_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit id per set (0 for an empty one): equal sets, equal ids."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(tokens ^ U(0x5DEECE66D)), at) + sizes[full].astype(np.uint64))
    return out
