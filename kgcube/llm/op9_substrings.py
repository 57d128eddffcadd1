"""Removal of passages of 50 words that stand in an earlier document.

0. Texts. Documents with one text are a class, its smallest id the class's document; all other members of
   50 words and more lose every word, so only distinct texts take part in what follows. Texts are dealt to
   buckets by row, whatever their ids are.
1. Anchors. Of the 16-word phrases in each 50-word window the one with the least hash is the window's
   anchor, so equal windows have equal anchors and neighbours mostly share theirs. Each bucket gives its distinct
   anchors with its smallest and largest id; an anchor is recurring if documents with different ids have it.
2. Confirmed windows. In each bucket the windows with a recurring anchor are hashed; a window that two
   documents have belongs to the one with the smaller id. Each window is one row a bucket, so a passage
   in a third of all documents has no more rows than there are buckets.
3. Passages. Owners' texts are cut to pieces of ``BLOCK`` windows; a bucket that has a window of such a piece
   in a document with a larger id gets it, once. Other windows with the same anchor don't matter.
4. Automata. Each bucket compiles its pieces into one Aho-Corasick automaton with pyahocorasick: the
   patterns are stretches of 25 words from each piece, end to end, of which every 50-word window holds
   a whole one. All documents of the bucket stream through it. Around each occurrence the windows are
   compared with those of the pieces, word by word, and words of windows that belong to a smaller
   document are removed.

Automata hold what their bucket's documents need, so their size is bounded by the bucket's. A text that a
third of all rows have is combined before the shuffle, and an anchor or a window has one row a bucket.
Steps 1 and 2, and 3 and 4, are one job each, in which the dealt text is shuffled once.

Defined cases: a null text has no words; texts of fewer than 50 words lose nothing; rows with one id are
one document for "another document has it", and each loses what stands in a smaller one; a null id
counts as larger than all others; a text of any length and vocabulary is one document of its bucket; other
columns, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgcube.llm.words import Words, covered, gram_hashes, whole, word_hashes

WINDOW, PHRASE = 50, 16
TILE = WINDOW // 2
#: Windows of a piece of an owner's text.
BLOCK = 128
#: Bytes of text that a bucket has about.
BUCKET_BYTES = 4_000_000
LEAST_BUCKETS = 48
#: Stands for a null id.
LAST = (1 << 63) - 1
#: Bits of a position while the least of some hashes is looked for; the hash has the others.
AT_BITS = 22

ANCHORS = "key long, bucket int, lo long, hi long"
WINDOWS = "key long, bucket int, lo long, hi long, rid long, pos int"
PIECES = "rid long, block int, owner long, words string"


def anchors(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for windows at ``at`` where their anchor begins: the phrase with the
    least upper bits of its hash, the first of equals."""
    h = gram_hashes(hashes, PHRASE)
    span = WINDOW - PHRASE + 1
    n = len(h) - span + 1
    if n <= 0 or not len(at):
        return h, np.zeros(0, np.int64)
    least, low = np.empty(n, np.int64), np.uint64((1 << AT_BITS) - 1)
    step = (1 << AT_BITS) - span
    for a in range(0, n, step):
        v = h[a : a + step + span - 1] & ~low
        v |= np.arange(len(v), dtype=np.uint64)
        size = 1  # minima of runs by doubling
        while 2 * size <= span:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        v = np.minimum(v[: len(v) - span + size], v[span - size :])
        least[a : a + len(v)] = (v & low).astype(np.int64) + a
    return h, least[at]


def changes(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


class Text:
    """Words of some documents and their hashes, which are equal in all tasks; ``at``: where windows begin."""

    def __init__(self, texts: pa.Array):
        self.w = Words(texts)
        codes, words = self.w.codes()
        self.hash = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
        self.at = whole(self.w, WINDOW)


def column(batch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name), np.int64)


def table_batch(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def bounds(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and id, and where in it each key's rows begin and end."""
    order = np.lexsort((ids, keys))
    first = changes(keys[order])
    return order, np.stack([first, np.append(first[1:], len(keys))[: len(first)] - 1])


def bucket_anchors(key: tuple, docs: pa.Table) -> pa.Table:
    """Distinct anchors of a bucket, with the smallest and the largest id that have each."""
    t, ids = Text(table_batch(docs.select(["text"])).column("text")), column(docs, "id")
    h, place = anchors(t.hash, t.at)
    place = place[changes(place)]
    keys, ids = h[place], ids[t.w.doc[place]] if len(place) else ids[:0]
    order, (first, last) = bounds(keys, ids)
    out = [keys[order[first]].view(np.int64), np.full(len(first), key[0].as_py(), np.int32), ids[order[first]], ids[order[last]]]
    return pa.table([pa.array(x) for x in out], names=["key", "bucket", "lo", "hi"])


def bucket_windows(key: tuple, docs: pa.Table, recurring: pa.Table) -> pa.Table:
    """Distinct windows with a recurring anchor: the smallest and the largest id that have each, and where in the former's text."""
    docs = table_batch(docs)
    t = Text(docs.column("text"))
    h, place = anchors(t.hash, t.at)
    first = changes(place)
    known = np.isin(h[place[first]], column(recurring, "key").view(np.uint64))
    at = t.at[np.repeat(known, np.diff(np.append(first, len(place))))] if len(place) else t.at[:0]
    doc = t.w.doc[at]
    keys, ids = gram_hashes(t.hash, WINDOW)[at] if len(at) else np.zeros(0, np.uint64), column(docs, "id")[doc]
    order, (first, last) = bounds(keys, ids)
    doc, at = doc[order[first]], at[order[first]]
    out = [keys[order[first]].view(np.int64), np.full(len(first), key[0].as_py(), np.int32), ids[order[first]], ids[order[last]], column(docs, "rid")[doc], (at - t.w.first[doc]).astype(np.int32)]
    return pa.table([pa.array(x) for x in out], names=["key", "bucket", "lo", "hi", "rid", "pos"])


def bucket_pieces(key: tuple, docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The wanted pieces of texts: their words from the first window of a block to the end of the last one."""
    docs = table_batch(docs.select(["rid", "id", "text"]).filter(pc.is_in(docs.column("rid"), value_set=wanted.column("rid").combine_chunks().unique())))
    w, row = Words(docs.column("text")), {r: i for i, r in enumerate(docs.column("rid").to_pylist())}
    raw, ids, words = w.data.tobytes(), docs.column("id"), []
    for rid, block in zip(wanted.column("rid").to_pylist(), wanted.column("block").to_pylist(), strict=True):
        a, b = int(w.first[row[rid]]) + block * BLOCK, int(w.first[row[rid] + 1])
        s = slice(a, min(b, a + BLOCK + WINDOW - 1))
        words.append(b" ".join(raw[x:y] for x, y in zip(w.starts[s].tolist(), w.ends[s].tolist(), strict=True)).decode())
    owner = ids.take(pa.array([row[r] for r in wanted.column("rid").to_pylist()], pa.int64()))
    return pa.table([wanted.column("rid"), wanted.column("block"), owner, pa.array(words, pa.string())], names=["rid", "block", "owner", "words"])


def symbols(codes: np.ndarray, size: int) -> tuple[str, int]:
    """(text, characters a word) for codes below ``size``: each character of a word is from a range of its own,
    so that a node has at most 128 children (pyahocorasick looks through them one by one) and matches
    begin where words do."""
    k = max(1, -(-max(size - 1, 1).bit_length() // 7))
    grid = np.empty((len(codes), k), np.uint32)
    for j in range(k):
        grid[:, j] = 0x4E00 + 128 * j + (codes >> 7 * (k - 1 - j) & 127)
    return grid.tobytes().decode("utf-32-le"), k


def automaton(codes: np.ndarray, w: Words, size: int):
    """Of the stretches of pieces (as words of codes)."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    text, k = symbols(codes, size)
    for first, many in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        for i in range(first, first + many - TILE + 1, TILE):
            a.add_word(text[k * i : k * (i + TILE)], 1)
    if len(a):
        a.make_automaton()
    return a


def removed_words(docs: pa.RecordBatch, pieces: pa.Table) -> tuple[Words, np.ndarray]:
    """Words of the documents, and which of them lie in a window of a piece of a smaller document."""
    w = Words(docs.column("text"))
    gone = np.zeros(len(w), bool)
    if not pieces.num_rows or not len(w):
        return w, gone
    dcodes, words = w.codes()
    p = Words(pieces.column("words").combine_chunks())
    own, piece_words = p.codes()
    at = np.asarray(pc.fill_null(pc.index_in(piece_words, value_set=words), -1), np.int64)
    size = len(words) + len(piece_words)
    pcodes = np.where(at < 0, len(words) + np.arange(len(at)), at)[own]
    owner, ids = column(pieces, "owner"), column(docs, "id")
    machine = automaton(pcodes, p, size)
    if not len(machine):
        return w, gone
    known = np.zeros(size, bool)
    known[pcodes] = True
    here = np.append(0, np.cumsum(known[dcodes]))
    possible = np.flatnonzero(here[TILE:] - here[:-TILE] == TILE) if len(w) >= TILE else []  # else no stretch can match
    ends = []
    for i in np.unique(w.doc[possible]).tolist() if len(possible) else []:
        a, b = int(w.first[i]), int(w.first[i + 1])
        text, k = symbols(dcodes[a:b], size)
        ends += [a + e // k for e, _ in machine.iter(text)]
    if not ends:
        return w, gone
    # windows that hold a located stretch whole
    near = np.zeros(len(w) + 1, np.int64)
    last = np.array(ends)
    np.add.at(near, np.maximum(last - WINDOW + 1, 0), 1)
    np.add.at(near, last - TILE + 2, -1)
    at = whole(w, WINDOW)
    at = at[np.cumsum(near)[at] > 0]
    where = whole(p, WINDOW)
    ph, dh = gram_hashes(pcodes.astype(np.uint64), WINDOW)[where], gram_hashes(dcodes.astype(np.uint64), WINDOW)[at]
    order = np.lexsort((owner[p.doc[where]], ph))
    where, ph = where[order], ph[order]
    k = np.minimum(np.searchsorted(ph, dh), len(ph) - 1)
    ok = (ph[k] == dh) & (owner[p.doc[where[k]]] < ids[w.doc[at]])
    at, k = at[ok], k[ok]
    for part in np.array_split(np.arange(len(at)), max(1, len(at) >> 16)):
        same = np.ones(len(part), bool)
        for j in range(WINDOW):
            same &= dcodes[at[part] + j] == pcodes[where[k[part]] + j]
        gone |= covered(len(w), at[part[same]], WINDOW)
    return w, gone


def kept_text(w: Words, keep: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The kept words of all texts, joined by spaces, and the range of each text."""
    sizes = w.ends - w.starts
    data, _ = w.packed()
    if not keep.all():
        data, sizes = data[np.repeat(keep, sizes)], sizes[keep]
    out = np.full(len(data) + len(sizes), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    n = np.concatenate(([0], np.cumsum(np.bincount(w.doc[keep], minlength=len(w.counts)))))
    return out.tobytes(), [(a, max(a, b - 1)) for a, b in zip(at[n[:-1]].tolist(), at[n[1:]].tolist(), strict=True)]


def bucket_result(texts: bool):
    """Of each text of a bucket: words, removed words, and the digest of what is kept; with texts that, too."""

    def run(key: tuple, docs: pa.Table, pieces: pa.Table) -> pa.Table:
        batch = table_batch(docs)
        w, gone = removed_words(batch, pieces)
        n_removed = np.bincount(w.doc[gone], minlength=batch.num_rows).astype(np.int64)
        raw, off = kept_text(w, ~gone)
        out = [batch.column("h"), batch.column("id"), pa.array(w.counts), pa.array(n_removed), pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in off], pa.string())]
        return pa.table(out + [pa.array([raw[a:b].decode() for a, b in off], pa.string())] * texts, names=["h", "least", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    return run


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(id, h): the id, null as LAST, and the hash of the text; with the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.sha2(text, 256)).alias("h"), text.alias("text"))


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; with ``texts`` also ``kept``, what is left."""
    from kgcube.llm.store import stored

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(LEAST_BUCKETS, size // BUCKET_BYTES + 1))
    rows = distinct_texts(docs)
    bucket = F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int")
    one = rows.groupBy("h").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
    reps = stored(one.select(F.monotonically_increasing_id().alias("rid"), "h", "id", "text"))
    same = W.partitionBy("key")  # a key has one row a bucket

    by = reps.select(bucket.alias("bucket"), "rid", "id", "text").groupBy("bucket")
    found = by.applyInArrow(bucket_anchors, ANCHORS).withColumns({"least": F.min("lo").over(same), "most": F.max("hi").over(same)})
    needed = found.where("least < most").select("bucket", "key")
    windows = by.cogroup(needed.groupBy("bucket")).applyInArrow(bucket_windows, WINDOWS)
    taken = windows.withColumn("o", F.min(F.struct("lo", "rid", "pos")).over(same)).where("o.lo < hi")
    wanted = stored(taken.select("o.rid", F.floor(F.col("o.pos") / BLOCK).cast("int").alias("block"), "bucket").distinct())

    by = reps.select(bucket.alias("bucket"), "rid", "id", "h", "text").groupBy("bucket")
    pieces = by.cogroup(wanted.select("rid", "block").distinct().groupBy(bucket.alias("bucket"))).applyInArrow(bucket_pieces, PIECES)
    sent = wanted.join(pieces, ["rid", "block"]).select("bucket", "owner", "words")
    result = "h binary, least long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    judged = by.cogroup(sent.groupBy("bucket")).applyInArrow(bucket_result(texts), result)

    copy = (F.col("id") > F.col("least")) & (F.col("n_words") >= WINDOW)
    out = rows.select("doc_id", "id", "h").join(judged, "h")
    return out.select(
        F.col("doc_id").cast("long"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), *([F.when(copy, "").otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
