"""Vectorised helpers over batches of UTF-8 texts held as one byte buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

#: ASCII white space [\x20\x09-\x0D]; every other byte belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, ASCII letters and every byte above 0x7F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def flatten(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one uint8 buffer with eight spare bytes, and len + 1 offsets; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    body = array.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(array) else np.zeros(0, np.uint8)
    data = np.zeros(len(raw) + 8, dtype=np.uint8)
    data[: len(raw)] = raw
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the index of its first word (len + 1 values)."""
    n = int(offsets[-1])
    inside = table[data[:n]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; data has eight spare bytes at its end."""
    lanes = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _GOLD + _GOLD)
    todo, at, left = np.arange(len(starts)), starts, sizes
    while len(todo):
        out[todo] = mix(out[todo] * _GOLD ^ (lanes[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `size` consecutive values (modulo 2**64, then mixed)."""
    n = len(values)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def inside_text(first_word: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` words of the batch, whether it stays within one text."""
    n = int(first_word[-1])
    ok = np.ones(max(n - size + 1, 0), dtype=bool)
    for cut in first_word[1:-1]:
        ok[max(cut - size + 1, 0) : cut] = False
    return ok


def covered(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a run that begins at one of `starts`."""
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
