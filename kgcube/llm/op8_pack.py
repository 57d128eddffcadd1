"""Harmonic packing of token sequences.

Whole sequences are cut from each document first; what is left, its tail, is shorter than the capacity C.
Class k takes the tails of over C / (k + 1) and at most C / k tokens, and a bin of it has exactly k of them,
uncut. The gap that they leave, less than C / (k + 1), is closed by the next tails of the class, the fillers,
which are laid end to end and cut where a gap ends; of a filler only what fits no gap yet stays, in the class
of its new length. So bins have no padding, and only fillers are cut. Every task fills the bins of each class
on its own, without a shuffle; the few tails that it has left in the end are laid end to end, cut at the
capacity, and the last of them at powers of two, which need no padding either.

Ids are those of the tokenizers library (see Encoder). To encode each distinct run up to a single space or the end of a word once a
chunk is exact for this byte-level vocabulary: its pattern begins a new piece at such a space, if the
characters around it aren't white space, and where a run of letters ends.

Defined cases: a null text is empty, and is its end id alone; the string of a special token within a text is
ordinary text (encode_special_tokens of the library); repeated rows and rows with null or equal ids are packed
each on its own; a text of any length is cut; an empty table gives an empty table; other columns, whatever
their names, are not read; a capacity below one is an error.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.words import buffers, chunks

CAPACITY, END = 1024, 0
#: Bits of the number of a bin in its task; the sequence id has the task above them.
BIN_BITS = 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Distinct runs whose ids a worker remembers; it then starts anew.
REMEMBERED = 800_000

_encoders: dict = {}


class Encoder:
    """Ids of a byte-level tokenizer file. Its vocabulary is handed to tiktoken, which gives the same
    ids as the tokenizers library in a fraction of the time; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token) and i < len(vocabulary) - 1}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def ids(self, distinct: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each string."""
        known, encode, out = self.known, self.encode, []
        if len(known) > REMEMBERED:
            known.clear()
        for x in distinct:
            b = known.get(x)
            if b is None:
                b = array("I", encode(x)).tobytes()
                if len(x) < 32:
                    known[x] = b
            out.append(b)
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut before each space between two characters known not to be white space, and where a
    letter is followed by another ASCII character than a letter or digit:
    (code of each run, runs before each text, distinct runs)."""
    data, off = buffers(texts)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        graphic = (data > 0x20) & (data < 0x7F)
        latin = np.zeros(n, bool)  # last byte of a letter of U+00C0..U+00FF
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        before = graphic | latin
        after = graphic | (data == 0xC3)
        letter = latin | ((data | 0x20) - np.uint8(97) < 26)
        other = (data < 0x80) & ~letter & ((data < 48) | (data > 57))
        cut[1 : n - 1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
        cut[1:n] |= letter[:-1] & other[1:]
    cut[off] = True
    cut[n] = True
    at = np.flatnonzero(cut)
    size = len(at) - 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), pa.array([], pa.large_string())
    arr = pa.LargeStringArray.from_buffers(size, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    d = arr.dictionary_encode()
    return np.asarray(d.indices, np.int64), np.searchsorted(at, off), d.dictionary


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by the end id; offsets)."""
    codes, first, distinct = runs(texts)
    found = encoder(path).ids(distinct.to_pylist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    begin = np.cumsum(sizes) - sizes
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    place = np.cumsum(n) - n
    doc = np.searchsorted(first, np.arange(len(codes)), "right") - 1
    tokens = np.bincount(doc, n, minlength=len(first) - 1).astype(np.int64) + 1
    off = np.concatenate(([0], np.cumsum(tokens)))
    ids = np.full(off[-1], END, np.uint32)
    if len(codes):
        shift = np.repeat(begin[codes] - place, n)
        source = np.arange(int(n.sum())) + shift
        ids[np.arange(len(source)) + np.repeat(doc, n)] = flat[source]
    return ids, off


#: Columns of a task's tables of tails and pieces: where they begin in the token buffer, and in their document.
DOC, TOKENS, START, LENGTH, AT = range(5)


def cut(rows: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows laid end to end and cut at the edges, from the first edge (0) to the last one:
    (pieces, where each begins, and what is left of the rows)."""
    ends = np.concatenate(([0], np.cumsum(rows[:, LENGTH])))
    points = np.union1d(edges, ends[ends < edges[-1]])
    begin, size = points[:-1], np.diff(points)
    of = np.searchsorted(ends, begin, "right") - 1
    pieces = rows[of]
    pieces[:, [START, AT]] += (begin - ends[of])[:, None]
    pieces[:, LENGTH] = size
    first = int(np.searchsorted(ends, edges[-1], "right")) - 1
    left = rows[first:].copy()
    if len(left):
        used = edges[-1] - ends[first]
        left[0, [START, AT]] += used
        left[0, LENGTH] -= used
    return pieces, begin, left


class Packer:
    """Bins of one task."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, task << BIN_BITS
        self.tails, self.tokens = np.zeros((0, 5), np.int64), np.zeros(0, np.uint32)

    def bins(self, pieces: np.ndarray, number: np.ndarray, offset: np.ndarray, many: int) -> np.ndarray:
        out = np.column_stack([pieces, self.next + number, offset])
        self.next += many
        return out

    def add(self, doc_id: np.ndarray, ids: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Pieces (tables of tail columns, sequence and offset) of the bins that these documents fill."""
        c, at = self.capacity, off[:-1] + len(self.tokens)
        self.tokens = np.concatenate([self.tokens, ids])
        tokens = np.diff(off)
        full = tokens // c
        row = np.repeat(np.arange(len(tokens)), full)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)) * c
        whole = np.column_stack([doc_id[row], tokens[row], start, np.full(len(row), c), at[row] + start])
        out = [self.bins(whole, np.arange(len(row)), np.zeros(len(row), np.int64), len(row))]
        tails = np.column_stack([doc_id, tokens, full * c, tokens - full * c, at + full * c])
        tails = np.concatenate([self.tails, tails[tails[:, LENGTH] > 0]])
        k = c // tails[:, LENGTH]
        order = np.argsort(k, kind="stable")
        tails, left = tails[order], []
        for part in np.split(tails, np.flatnonzero(np.diff(k[order])) + 1):
            if len(part):
                left.append(self.fill(part, int(c // part[0, LENGTH]), out))
        self.tails = np.concatenate(left) if left else tails
        return out

    def fill(self, rows: np.ndarray, k: int, out: list[np.ndarray]) -> np.ndarray:
        """As many bins as the tails of class k can fill; the tails that are left."""
        size = rows[:, LENGTH]
        most = len(rows) // k
        inside = size[: most * k].reshape(most, k)
        gaps = np.concatenate(([0], np.cumsum(self.capacity - inside.sum(1))))
        after = np.append(np.cumsum(size[::-1])[::-1], 0)[np.arange(most + 1) * k]
        n = int(np.flatnonzero(gaps <= after)[-1])  # the fillers of so many bins come after their tails
        if not n:
            return rows
        offset = np.cumsum(inside[:n], 1) - inside[:n]
        pieces, begin, left = cut(rows[n * k :], gaps[: n + 1])
        at = np.searchsorted(gaps[: n + 1], begin, "right") - 1
        place = inside[at].sum(1) + begin - gaps[at]
        out.append(self.bins(np.concatenate([rows[: n * k], pieces]), np.concatenate([np.repeat(np.arange(n), k), at]), np.concatenate([offset.ravel(), place]), n))
        return left

    def settle(self) -> None:
        """Keep no other tokens than those of the tails that wait."""
        size = self.tails[:, LENGTH]
        begin = np.cumsum(size) - size
        self.tokens = self.tokens[np.arange(size.sum()) + np.repeat(self.tails[:, AT] - begin, size)]
        self.tails[:, AT] = begin

    def close(self) -> list[np.ndarray]:
        total = int(self.tails[:, LENGTH].sum())
        if not total:
            return []
        rest = total % self.capacity
        last = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        edges = np.concatenate(([0], np.cumsum([self.capacity] * (total // self.capacity) + last)))
        pieces, begin, self.tails = cut(self.tails, edges)
        number = np.searchsorted(edges, begin, "right") - 1
        return [self.bins(pieces, number, begin - edges[number], len(edges) - 1)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with its sequence and place there."""
    if capacity < 1:
        raise ValueError(f"capacity {capacity} holds no token")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), capacity)

        def out(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            view = memoryview(packer.tokens.astype("<u4").tobytes())
            for t in tables:
                if len(t):
                    crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in t[:, [AT, LENGTH]].tolist()]
                    columns = (t[:, START], t[:, LENGTH], np.array(crc, np.int64), t[:, TOKENS], t[:, 5], t[:, 6])
                    yield pa.RecordBatch.from_arrays([pa.array(t[:, DOC], mask=t[:, DOC] == NULL_ID), *map(pa.array, columns)], names=names)

        for batch in batches:
            for part in chunks(batch):
                ids, off = encode(part.column("text"), tokenizer_path)
                yield from out(packer.add(np.asarray(part.column("doc_id").fill_null(NULL_ID), np.int64), ids, off))
                packer.settle()
        yield from out(packer.close())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


#: Stands for a null doc_id in the task's integer tables.
NULL_ID = -(1 << 63)
