"""Arrow text columns as flat numpy bytes, and the hashing of their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial and of the places in a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
MASK64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * PLACES[0]
    x = (x ^ (x >> np.uint64(27))) * PLACES[1]
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BYTE = np.where(_SPACE, np.uint64(0), BYTE)
_WORD_BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]


def powers(n: int) -> np.ndarray:
    """BASE to 0, 1, ... n - 1."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of values with about limit bytes each, or one longer value."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words_at(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where words begin: bytes of the kind inside[byte] after others, or first in their value."""
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = word[begins]
    return np.flatnonzero(first)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z as a-z, if table isn't given), and where each value's words begin (n + 1 places). Bytes of 0 in table separate words."""
    starts = words_at(data, offsets, table != 0)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    spans = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    value = table[data[starts[0] :]] * powers(int(spans.max()))[place]
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each value's runs of size words (fewer words: of all of them), and where each value's begin."""
    h, at = word_hashes(data, offsets)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    run = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        run += h[j : len(h) - size + 1 + j] * PLACES[j]
    inside = owner[: len(run)] == owner[size - 1 :]
    run, owner = mix(run[inside]), owner[: len(run)][inside]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        short = np.array([(sum(int(x) * int(PLACES[j]) for j, x in enumerate(h[at[d] : at[d + 1]])) + int(n[d])) & MASK64 for d in few], np.uint64)
        run, owner = np.concatenate([run, mix(short)]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        run, owner = run[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        run[a:b].sort()
    if len(run):
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
        run, owner = run[new], owner[new]
    return run, np.searchsorted(owner, np.arange(len(n) + 1))
