"""Benchmark decontamination.

A training document is compared with a benchmark by windows of normalised words: ASCII letters are
lower-cased and words are runs of digits, letters and non-ASCII characters. Every window of an item
goes into a hash set that is broadcast in blocks of bounded size; documents are scanned where they
lie, without a shuffle, and each hash hit is checked word by word.

What is broadcast at a time has at most ``MOST_BYTES`` of benchmark text. A larger benchmark is dealt by hash of
its items to as many passes as that takes: each pass broadcasts its part, scans all documents for it, gives the
hit words and items of the few that have any, and frees it; these are added up by document in the end.

Defined cases: a null text has no words and is never contaminated; an item without words has no
window; an item of fewer than ``k`` words is one window; a null item id counts as the empty string;
repeated rows are judged one by one; an empty benchmark leaves every document clean; further columns
of either table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.words import NOT_ALNUM, Words, chunks, covered, gram_hashes

#: Benchmark text in one broadcast block, and in all blocks of a pass.
BLOCK_BYTES, MOST_BYTES = 16 << 20, 64 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of one block of items by word count: sorted hashes, exact codes and the items of each."""

    def __init__(self, items: list[tuple[str, str]], k: int):
        w = Words(pa.array([t for _, t in items], pa.large_string()), NOT_ALNUM, lower=True)
        codes, self.vocabulary = w.codes()
        codes = codes + 1
        self.by_length = []
        lengths = np.minimum(w.counts, k)
        for length in np.unique(lengths[lengths > 0]).tolist():
            starts = [np.arange(w.first[i], w.first[i + 1] - length + 1) for i in np.flatnonzero(lengths == length)]
            owners = np.repeat(np.flatnonzero(lengths == length), [len(s) for s in starts])
            grid = codes[np.concatenate(starts)[:, None] + np.arange(length)]
            distinct, which = np.unique(grid, axis=0, return_inverse=True)
            seed, hashes = 0, window_hashes(distinct)
            while len(np.unique(hashes)) < len(hashes):  # two windows share a hash: take others
                seed += 1
                hashes = window_hashes(distinct, seed)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            uid = rank[which.ravel()]
            pairs = np.unique(np.stack([uid, owners], 1), axis=0)
            at = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
            self.by_length.append((length, seed, hashes[order], distinct[order], pairs[:, 1], at))

    def hits(self, w: Words, codes: np.ndarray, hit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Mark hit words; return (document row, item) pairs."""
        found = []
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        for length, seed, hashes, exact, owners, at in self.by_length:
            n = len(codes) - length + 1
            if n <= 0:
                continue
            start = np.flatnonzero((known[length:] - known[:-length] == length) & (w.doc[:n] == w.doc[length - 1 :]))
            for part in np.array_split(start, max(1, len(start) >> 18)):
                grid = codes[part[:, None] + np.arange(length)]
                h = window_hashes(grid, seed)
                where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                ok = (hashes[where] == h) & (exact[where] == grid).all(1)
                part, where = part[ok], where[ok]
                if len(part):
                    hit |= covered(len(codes), part, length)
                    many = at[where + 1] - at[where]
                    flat = np.repeat(at[where], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    found.append((np.repeat(w.doc[part], many), owners[flat]))
        return found


def window_hashes(grid: np.ndarray, seed: int = 0) -> np.ndarray:
    length = grid.shape[1]
    flat = np.ascontiguousarray(grid).ravel().astype(np.uint64) ^ np.uint64(seed << 40)
    return gram_hashes(flat, length)[::length] if len(grid) else np.zeros(0, np.uint64)


_sets: dict[tuple, WindowSet] = {}


def _window_set(block, k: int) -> WindowSet:
    """The block's set, kept by this worker while the blocks of one pass are in use."""
    name, items = block.value
    if (name, k) not in _sets:
        while len(_sets) > MOST_BYTES // BLOCK_BYTES:
            _sets.pop(next(iter(_sets)))
        _sets[name, k] = WindowSet(items, k)
    return _sets[name, k]


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null")


def broadcast_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast items(i, t) in blocks of at most ``block_bytes`` of text (one longer item is a block),
    each under a name of its own."""
    sc, blocks, block, size = items.sparkSession.sparkContext, [], [], 0
    send = lambda items: blocks.append(sc.broadcast((uuid.uuid4().hex, items)))
    for i, t, n in items.select("i", "t", F.octet_length("t")).toLocalIterator():
        if block and size + n > block_bytes:
            send(block)
            block, size = [], 0
        block.append((i, t))
        size += n
    if block:
        send(block)
    return blocks


def passes(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The items, in parts of about ``most`` bytes."""
    items = items_of(benchmark)
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = int(-(-size // most))
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def judge(texts: pa.Array, blocks: list, k: int = 13) -> tuple[Words, np.ndarray, list[list[str]]]:
    """Words of the texts, which of them are hit, and for each text the items that occur in it."""
    w = Words(texts, NOT_ALNUM, lower=True)
    local, vocabulary = w.codes()
    hit, items = np.zeros(len(w), bool), [set() for _ in range(len(texts))]
    for block in blocks:
        windows = _window_set(block, k)
        at = np.asarray(pc.fill_null(pc.index_in(vocabulary, value_set=windows.vocabulary), -1), np.int64) + 1
        for rows, owners in windows.hits(w, at[local] if len(local) else local, hit):
            for r, o in np.unique(np.stack([rows, owners], 1), axis=0).tolist():
                items[r].add(block.value[1][o][0])
    return w, hit, [sorted(x) for x in items]


def counts(w: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hit words of each text, and whether it is contaminated."""
    n_hit = np.bincount(w.doc[hit], minlength=len(w.counts)).astype(np.int64)
    return n_hit, (n_hit > 0) & (20 * n_hit >= w.counts)


def marked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """docs(_row, text) -> _row, n_words, hits (ranges of hit words) and items of those that are hit by the part."""
    blocks = broadcast_blocks(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w, hit, found = judge(part.column("text"), blocks, k)
                rows = np.unique(w.doc[hit])
                ranges = []
                for i in rows.tolist():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[w.first[i] : w.first[i + 1]].astype(np.int8), [0]))))
                    ranges.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                hits = pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(ROW).take(pa.array(rows)), hits, pa.array([found[i] for i in rows.tolist()], pa.list_(pa.string()))], names=[ROW, "hits", "items"])

    from kgcube.llm.store import stored

    out = stored(docs.select(ROW, "text").mapInArrow(run, f"{ROW} long, hits array<struct<start:long,stop:long>>, items array<string>"))
    for b in blocks:
        b.destroy()
    return out


#: A column that documents have for a while.
ROW = "_kgcube_row"


def in_passes(docs: DataFrame, parts: list[DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """Documents with a row number, and what all passes found by it: hits and items, the union of theirs."""
    from kgcube.llm.store import stored

    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = marked(rows, parts[0], k)
    for part in parts[1:]:
        found = found.unionByName(marked(rows, part, k))
    return rows, found.groupBy(ROW).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def hit_words(w: Words, hits: list) -> np.ndarray:
    """Which words lie in the ranges of their texts."""
    start, size = [], []
    for i, ranges in enumerate(hits):
        for r in ranges or ():
            start.append(int(w.first[i]) + r["start"])
            size.append(r["stop"] - r["start"])
    return covered(len(w), np.array(start, np.int64), np.array(size, np.int64))


def verdicts(part: pa.RecordBatch, w: Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    n_hit, bad = counts(w, hit)
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(w.counts), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(bad)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def cleaned(part: pa.RecordBatch, w: Words, hit: np.ndarray, spans: bool) -> pa.RecordBatch:
    if not spans:
        return part.filter(pa.array(~counts(w, hit)[1]))
    raw, off = part.column("text").to_pylist(), w.offsets
    for i in np.unique(w.doc[hit]).tolist():
        text, at, out = raw[i].encode(), 0, []
        for j in np.flatnonzero(hit[w.first[i] : w.first[i + 1]]) + w.first[i]:
            out.append(text[at : w.starts[j] - off[i]])
            at = w.ends[j] - off[i]
        raw[i] = b"".join([*out, text[at:]]).decode()
    k_text = part.schema.get_field_index("text")
    return part.set_column(k_text, part.schema.field(k_text), pa.array(raw, part.schema.field(k_text).type))


def applied(docs: DataFrame, benchmark: DataFrame, k: int, most: int, make, schema) -> DataFrame:
    """``make`` of each chunk of documents, its words, which are hit, and the items of each document."""
    parts = passes(benchmark, most)
    if len(parts) == 1:
        blocks = broadcast_blocks(parts[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    yield make(part, *judge(part.column("text"), blocks, k))

        return docs.mapInArrow(run, schema)
    rows, found = in_passes(docs, parts, k)

    def run_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"), NOT_ALNUM, lower=True)
                own = part.drop_columns([ROW, "_kgcube_hits", "_kgcube_items"])
                yield make(own, w, hit_words(w, part.column("_kgcube_hits").to_pylist()), [x or [] for x in part.column("_kgcube_items").to_pylist()])

    found = found.withColumnsRenamed({"hits": "_kgcube_hits", "items": "_kgcube_items"})
    return rows.join(found, ROW, "left").mapInArrow(run_found, schema)


def scan(docs: DataFrame, benchmark: DataFrame, k: int = 13, most: int = MOST_BYTES) -> DataFrame:
    """One row per document: words, hit words, items with a window in it, and the verdict."""
    return applied(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, k, most, verdicts, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 13, spans: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """The documents (all their columns) without contaminated ones; with ``spans``, what is left of
    them and of lightly hit ones after cutting out the hit words is kept instead."""
    return applied(docs, benchmark, k, most, lambda part, w, hit, items: cleaned(part, w, hit, spans), docs.schema)
