"""Words of whole texts as numpy arrays, for use inside Spark tasks.

A chunk of documents is one UTF-8 byte buffer. Words are byte ranges in it, found with a 256-entry
table that says which bytes separate words. All separators are ASCII, so no multi-byte character is
ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one chunk holds, unless a single text is longer.
CHUNK_BYTES = 4 << 20

#: Separators of words [^\x20\x09-\x0D]+
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part has about ``most`` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


class Words:
    """Words of a chunk of texts: ``starts`` and ``ends`` (bytes), ``doc`` (row of each word),
    ``counts`` and ``first`` (words of each row and index of its first one)."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = WHITE, lower: bool = False):
        self.data, self.offsets = buffers(texts)
        if lower:
            self.data = lower_ascii(self.data)
        n, size = len(self.offsets) - 1, len(self.data)
        inside = ~separators[self.data]
        self.inside = inside
        border = np.zeros(size + 1, bool)
        border[self.offsets] = True
        start, end = inside.copy(), inside.copy()
        if size:
            start[1:] &= ~inside[:-1] | border[1:size]
            end[:-1] &= ~inside[1:] | border[1:size]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without what lies between them, and offsets."""
        return self.data[self.inside], np.concatenate(([0], np.cumsum(self.ends - self.starts)))

    def array(self) -> pa.Array:
        data, off = self.packed()
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """For each word the index of its text among the chunk's distinct words, and these."""
        d = self.array().dictionary_encode()
        return np.asarray(d.indices, np.int64), d.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes that depend on the words' bytes alone, equal in every task."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []
#: Odd, with an inverse modulo 2^64.
_BASE = 0xD6E8FEB86659FD93


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least; a worker keeps those of a usual chunk."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, 1 << 20)
    with np.errstate(over="ignore"):
        made = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    if size <= 1 << 22:
        _powers[:] = made
    return made


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for every i, from prefix sums: O(n). Runs over borders of documents too."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(values))
    with np.errstate(over="ignore"):
        total = np.empty(len(values) + 1, np.uint64)
        total[0] = 0
        np.cumsum(mix(values.astype(np.uint64) + _MIX) * up[: len(values)], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[:n])


def whole(words: Words, k: int) -> np.ndarray:
    """Indices i for which words i .. i+k-1 lie in one document."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])


def covered(n: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in a range [s, s+k)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step[:n]) > 0
