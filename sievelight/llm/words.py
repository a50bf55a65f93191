"""Words and word shingles of whole texts as 64-bit hashes, with numpy over Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased. Hashes come from fixed random tables,
so they agree between tasks and runs. At 64 bits, n distinct items collide with a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = _SEED.integers(1, 2**63, 64, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once; a longer text is taken in pieces that end at white space.
PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            f = np.full(size, _BASE, np.uint64)
            g = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            f[0] = g[0] = 1
            cls.up, cls.down = np.cumprod(f, dtype=np.uint64), np.cumprod(g, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins and the last ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _hash(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer, the position and the length of each; a word also ends where one of ``starts`` is."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts >= 0) & (starts < len(buf))]
    first[inner] |= word[inner]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, begin
    up, down = _Powers.to(len(buf) + 1)
    v = _BYTE[buf] * up[: len(buf)]
    v[~word] = 0
    h = np.add.reduceat(v, begin) * down[begin]
    n = np.add.reduceat(word.astype(np.int64), begin)
    return mix(h + n.astype(np.uint64) * np.uint64(_BASE)), begin, n


def blocks(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds) for runs of rows of about ``size`` bytes: the word hashes of rows first to last - 1,
    and where each row's begin and the last's end."""
    buf, at = texts(column)
    i, rows = 0, len(at) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, rows)
        if at[j] - at[i] > 2 * size:
            parts = [_hash(x, np.zeros(0, np.int64))[0] for x in _pieces(buf[at[i] : at[j]], size)]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield i, j, h, np.array([0, len(h)])
        else:
            h, begin, _ = _hash(buf[at[i] : at[j]], at[i:j] - at[i])
            yield i, j, h, np.searchsorted(begin, at[i : j + 1] - at[i])
        i = j


def _pieces(buf: np.ndarray, size: int) -> Iterator[np.ndarray]:
    i = 0
    while i < len(buf):
        j = min(len(buf), i + size)
        while j < len(buf):
            gap = np.flatnonzero(_SPACE[buf[j : j + size]])
            if len(gap):
                j += int(gap[0])
                break
            j = min(len(buf), j + size)
        yield buf[i:j]
        i = j


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each row; a row of fewer words has its whole sequence as one."""
    out = []
    n = len(hashes) - k + 1
    if n > 0:
        s = np.full(n, _LENGTH[k], np.uint64)
        for i in range(k):
            s += hashes[i : i + n] * _PLACE[i]
        s = mix(s)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= k:
            x = np.sort(s[lo : hi - k + 1])
            if len(x) > 1:
                keep = np.ones(len(x), bool)
                keep[1:] = x[1:] != x[:-1]
                x = x[keep]
            out.append(x)
        elif hi > lo:
            m = hi - lo
            out.append(mix((hashes[lo:hi] * _PLACE[:m]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[m : m + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pieced(column: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows of about ``size`` bytes, as bytes and where rows begin; a longer text in pieces that end at white space."""
    buf, at = texts(column)
    i, rows = 0, len(at) - 1
    while i < rows:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1), rows)
        part = buf[at[i] : at[j]]
        yield from [(part, at[i:j] - at[i])] if len(part) <= 2 * size else [(x, np.zeros(0, np.int64)) for x in _pieces(part, size)]
        i = j


def prefixes(buf: np.ndarray, begin: np.ndarray, n: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths from 1: the words, by their begins and lengths, that are as long, and the hashes of their first bytes."""
    up, sums, live = _Powers.to(longest + 1)[0], np.zeros(len(begin), np.uint64), np.arange(len(begin))
    for k in range(1, longest + 1):
        live = live[n[live] >= k]
        if not len(live):
            return
        sums[live] += _BYTE[buf[begin[live] + (k - 1)]] * up[k - 1]
        yield live, mix(sums[live] + np.uint64(k * _BASE % (1 << 64)))


class Table:
    """Places of 64-bit keys by open addressing; arrays of keys are looked up and added at once. At most half is filled."""

    def __init__(self, room: int):
        """``room``: the most keys."""
        bits = max(4, int(2 * room - 1).bit_length())
        self._keys, self._mask, self.room, self.filled = np.zeros(1 << bits, np.uint64), np.uint64((1 << bits) - 1), room, 0

    def __len__(self) -> int:
        return len(self._keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, or the free one where it would go, and whether it is there."""
        keys = np.maximum(keys, np.uint64(1))  # 0 marks a free place
        at = (keys & self._mask).astype(np.int64)
        held = self._keys[at]
        here = held == keys
        open_ = np.flatnonzero(~here & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self._mask)
            held = self._keys[at[open_]]
            here[open_] = held == keys[open_]
            open_ = open_[(held != keys[open_]) & (held != 0)]
        return at, here

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Adds different keys that aren't there; their places."""
        if self.filled + len(keys) > self.room:
            raise ValueError("no room")
        self.filled += len(keys)
        keys = np.maximum(keys, np.uint64(1))
        out, todo = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(todo):
            at, _ = self.find(keys[todo])
            self._keys[at] = keys[todo]  # of keys that go to one place, one stays
            stays = self._keys[at] == keys[todo]
            out[todo[stays]] = at[stays]
            todo = todo[~stays]
        return out
