"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document has a 64-bit SimHash over its 3-word shingles; documents whose fingerprints differ in at
most two bits are linked. Copies collapse to distinct fingerprints first. A fingerprint is cut into
three segments of at most 22 bits, padded to 23. The binary Golay code (23, 12) decodes a segment to
the codewords within distance four of it: one if the nearest is within two bits, else six. Two
segments at most two bits apart have a codeword in common: the word halfway between them lies within
three bits of some codeword, as the code is perfect. By the pigeonhole principle one of the three
segments has no error when there are two or fewer in all, so each fingerprint has as keys, for each
segment, that segment as it is with each codeword of the next one. Fingerprints with a key in common
are compared.

Few keys are shared by many fingerprints, and these are not compared in pairs: the members of a key
with more than ``PAIRS`` of them are halved at their differing bits instead. Each member of such a
key emits itself and its one-bit neighbours; two fingerprints with such a word in common differ in at
most two bits, and all that differ in at most two bits have one in common, so linking every member
to the smallest of a word gives the components of the group without its pairs.

Links are few; their components come from alternating large-star and small-star steps.

Defined cases: a null text has no words and fingerprint zero; a text of one or two words is one
shingle; a null doc_id takes the component of its fingerprint and can't be its smallest document;
repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kgcube.llm.components import components
from kgcube.llm.words import Words, chunks

SEED, SHINGLE, MOST_BITS = 42, 3, 2
#: Members of a key up to which they are compared in pairs.
PAIRS = 48
#: Columns that documents have for a while.
FINGERPRINT, ROW = "_kgcube_fingerprint", "_kgcube_row"
SEGMENTS = ((0, 22), (22, 21), (43, 21))

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text."""
    w = Words(texts, lower=True)
    n = len(w.counts)
    out = np.zeros(n, np.uint64)
    if not len(w):
        return out
    data, off = w.packed()
    joined = np.full(len(data) + len(w), 32, np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(len(w)), np.diff(off))] = data
    starts, ends = off[:-1] + np.arange(len(w)), off[1:] + np.arange(len(w))
    shingles = np.where(w.counts >= SHINGLE, w.counts - SHINGLE + 1, np.minimum(w.counts, 1))
    has = np.flatnonzero(shingles)
    many = shingles[has]
    first = np.repeat(w.first[has], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(first + SHINGLE, np.repeat(w.first[has + 1], many)) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    edge = np.cumsum(many) - many
    for bit in range(64):
        ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), edge)
        out[has] |= (2 * ones.astype(np.int64) > many).astype(np.uint64) << np.uint64(bit)
    return out


class Golay:
    """For each syndrome the error words of weight at most four."""

    def __init__(self):
        bit = []
        for i in range(23):
            r = 1 << i
            for j in range(i, 10, -1):
                if r >> j & 1:
                    r ^= GENERATOR << (j - 11)
            bit.append(r)
        self.high, self.low = (self._sums(x) for x in (bit[11:], bit[:11]))
        errors: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                s = e = 0
                for p in places:
                    s, e = s ^ bit[p], e | 1 << p
                errors[s].append(e)
        self.many = np.array([len(x) for x in errors])
        self.errors = np.array([x + [0] * (6 - len(x)) for x in errors], np.uint64)

    @staticmethod
    def _sums(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, b in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ b
        return out

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the codewords near each 23-bit word; the index is its 12 upper bits."""
        w = words.astype(np.int64)
        s = self.high[w >> 11] ^ self.low[w & 0x7FF]
        rows = np.repeat(np.arange(len(w)), self.many[s])
        k = np.arange(len(rows)) - np.repeat(np.cumsum(self.many[s]) - self.many[s], self.many[s])
        return rows, (words[rows] ^ self.errors[s[rows], k]) >> np.uint64(11)


_golay: list[Golay] = []


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of each fingerprint."""
    if not _golay:
        _golay.append(Golay())
    parts = [(fp >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        r, index = _golay[0].indices(parts[(i + 1) % 3])
        rows.append(r)
        keys.append(np.uint64(i << 60) | exact[r] << np.uint64(12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed integer of the same bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def with_keys(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = (np.asarray(batch.column(c), np.int64) for c in ("fp", "node"))
            rows, keys = golay_keys(fp.view(np.uint64))
            for part in np.array_split(np.arange(len(rows)), max(1, len(rows) >> 16)):
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(fp[rows[part]]), pa.array(node[rows[part]])], names=["key", "fp", "node"])

    return nodes.mapInArrow(run, "key long, fp long, node long")


def close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between rows of one key that differ in few bits; rows come sorted by key, and no key has many."""
    tail = [np.zeros(0, np.int64)] * 3

    def compare(key, fp, node):
        fp = fp.view(np.uint64)
        found = []
        for step in range(1, PAIRS):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            ok = same[np.bitwise_count(fp[same + step] ^ fp[same]) <= MOST_BITS]
            found.append(np.stack([node[ok], node[ok + step]]))
        if found:
            a, b = np.concatenate(found, 1)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    for batch in batches:
        key, fp, node = (np.concatenate([t, np.asarray(batch.column(c), np.int64)]) for t, c in zip(tail, ("key", "fp", "node"), strict=True))
        if not len(key):
            continue
        cut = np.searchsorted(key, key[-1])
        tail = [x[cut:] for x in (key, fp, node)]
        if cut:
            yield from compare(key[:cut], fp[:cut], node[:cut])
    if len(tail[0]):
        yield from compare(*tail)


def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint and its one-bit neighbours."""
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        fp, node = (np.asarray(batch.column(c), np.int64) for c in ("fp", "node"))
        for part in np.array_split(np.arange(len(fp)), max(1, len(fp) >> 10)):
            words = fp[part].view(np.uint64)[:, None] ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(words.ravel().view(np.int64)), pa.array(np.repeat(node[part], len(flips)))], names=["word", "node"])


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at most two bits apart."""
    keyed = with_keys(nodes)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS).select("key")
    cold = keyed.join(hot, "key", "left_anti")
    pairs = cold.repartition("key").sortWithinPartitions("key").mapInArrow(close_pairs, "a long, b long")
    many = keyed.join(hot, "key", "left_semi").select("fp", "node").distinct()
    words = many.mapInArrow(halfway, "word long, node long")  # a word has at most 65 fingerprints
    stars = words.groupBy("word").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, stored) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    fps = stored(document_fingerprints(docs))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(nodes.where("node is not null")))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keyed(docs: DataFrame) -> DataFrame:
    """The documents, and in one more column, FINGERPRINT, their fp and the hash of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = part.column("text").to_pylist()
                h = [None if t is None else xxhash.xxh3_128_digest(t.encode()) for t in text]
                fp = pa.array(fingerprints(part.column("text")).view(np.int64))
                yield part.append_column(FINGERPRINT, pa.StructArray.from_arrays([fp, pa.array(h, pa.binary())], names=["fp", "h"]))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(FINGERPRINT, StructType([StructField("fp", LongType()), StructField("h", BinaryType())]))]))


def representatives(docs: DataFrame, stored) -> DataFrame:
    """One document (all its columns) of each component: the one with the smallest (doc_id, hash of the
    text), null ids last. Rows with null or shared ids count each by its own text."""
    rows = stored(keyed(docs).withColumn(ROW, F.monotonically_increasing_id()))
    at, fp = F.col(ROW), F.col(f"{FINGERPRINT}.fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{FINGERPRINT}.h").alias("h"), at.alias("at"))
    nodes = stored(rows.groupBy(fp.alias("fp")).agg(F.min(order).alias("least")).withColumn("node", F.col("least.at")))
    roots = components(links(nodes.select("node", "fp")))
    keep = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("least").alias("least"))
    return rows.join(keep.select(F.col("least.at").alias(ROW)), ROW, "left_semi").select(*docs.columns)
