"""Words of whole texts as numpy arrays.

A word is a maximal run of characters other than ASCII white space, ``[^\\x20\\x09-\\x0D]+``. All such characters are
single bytes in UTF-8, so words are found on the raw bytes of an Arrow column without building strings. Work is cut into
runs of about ``CHUNK`` bytes (one longer text is a run of its own), which bounds the memory of a task by the longest text.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(x):
        t = np.full(n, x, np.uint64)
        t[0] = 1
        return np.cumprod(t, dtype=np.uint64)

    return table(_BASE), table(_INVERSE)


class Texts:
    """A run of whole texts: the bytes of all, the offsets of each, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.n = len(offsets) - 1
        self.space = SPACE[self.data]
        solid = ~self.space
        first, last = solid.copy(), solid.copy()
        first[1:] &= self.space[:-1]
        last[:-1] &= self.space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)     # words of text i: bounds[i]:bounds[i + 1]
        self._sums: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(self.n), self.n_words)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def per_word_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a per-word array over each text."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit polynomial hashes of byte spans, all from one running sum; the hash depends on the content alone."""
        power, inverse = _powers(1 << (max(CHUNK, len(self.data)) - 1).bit_length())
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data + np.uint64(1)) * power[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each line (split at \\n)."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate((self.offsets[:-1], breaks + 1))
        end = np.concatenate((self.offsets[1:], breaks))
        start.sort()
        end.sort()
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1 if self.n else start

    def ngrams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of n-word windows inside texts, and the number of each window's first word."""
        if len(words) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(_BASE) + words[k: len(words) - n + 1 + k]
        at = np.flatnonzero(np.arange(len(h)) + n <= np.repeat(self.bounds[1:], self.n_words)[: len(h)])
        return mix(h[at]), at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64) \
        if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def runs(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts) for runs of rows of about CHUNK bytes."""
    data, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1))
        yield lo, hi, Texts(data[at[lo]: at[hi]], at[lo: hi + 1] - at[lo], lower)
        lo = hi


def repeated(keys: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Flags of the entries whose key occurs twice or more (later_only: without the first of each)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] = same
    if not later_only:
        flags[order[:-1]] |= same
    return flags


def forest(n: int, pairs) -> np.ndarray:
    """Smallest member reachable, over pairs of arrays (a, b) that come one after another."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (up := root[root] != root).any():
                root[up] = root[root][up]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of batches sorted by ``columns`` in tables that never part the rows of one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [pa.Table.from_batches(held).column(c).to_numpy() for c in columns]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        if len(change):
            table, cut = pa.Table.from_batches(held), int(change[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)
