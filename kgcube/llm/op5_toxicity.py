"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with marks for its ends); each n-gram has a vector in a
hashed table, a word is the mean of its vectors, a passage of ``PASSAGE`` words is their average over its
distinct words (a repeated or missing word adds nothing), and a linear softmax gives the passage's class. Vectors
and softmax are trained jointly in numpy with Adam (its divisor has a floor, so that n-grams of few documents move
little), first on evenly spread passages of each document, then on the passage that the model finds most toxic.
An unseen misspelling shares most n-grams with the word that it distorts.

The average is taken over passages, and a document is as toxic as its most toxic one, as a few insults in a long
text vanish in the average of all its words (the README compares both). As averages and softmax are linear, a model
of any width scores as one weight for each n-gram; the width only shapes the way there.

The fit takes at most ``SAMPLE`` labelled documents, those with the smallest hash of their id; all
documents are scored, whole, without a shuffle.

Defined cases: a null or empty text has the score of the bias alone; labels that are null, or of
documents that aren't there, are not used; of several labels of one document the largest counts, and of several
texts under one id the first in order; repeated rows and rows with a null id are scored each; without both classes
among the labels every score is zero; a text of any length is scored whole; language, source, id and further columns,
whatever their names, are no inputs of a score; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.words import Words, chunks, mix

#: Labelled documents that the model is fitted on at most.
SAMPLE = 10_000
BUCKETS, WIDTH, GRAMS = 1 << 18, 4, (3, 4, 5)
PASSAGE, SPREAD, WARM, ROUNDS, RATE, RARE = 64, 4, 20, 80, 0.5, 0.03
THRESHOLD = 0.7
#: Distinct words whose n-grams are found at a time, and n-grams that a step of the fit takes up at a time.
WORD_BLOCK, GRAM_BLOCK = 50_000, 1 << 19

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, first n-gram of each word) of distinct non-empty words."""
    text = "<" + "><".join(words.to_pylist()) + ">"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.asarray(pc.utf8_length(words), np.int64) + 2
    begin = np.cumsum(sizes) - sizes
    word, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(begin + sizes, sizes)
    at = np.arange(len(points))
    grams, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            ok = at[at + n <= ends]
            h = np.full(len(ok), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + points[ok + j]
            grams.append((mix(h) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(word[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(sizes)))


class Passages:
    """Texts as passages of word codes, and the n-grams of the distinct words."""

    def __init__(self, texts: pa.Array):
        codes, starts, docs, vocabularies, at, size, seen = [], [], [], [], 0, 0, 0
        for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"])):
            w = Words(part.column("text"), lower=True)
            own, words = w.codes()
            place = np.arange(len(w)) - w.first[w.doc] if len(w) else np.zeros(0, np.int64)
            first = place % PASSAGE == 0
            pairs = np.unique((np.cumsum(first) - 1) * len(words) + own)  # a passage is the set of its words
            of = pairs // max(len(words), 1)
            codes.append((pairs % max(len(words), 1) + seen).astype(np.int32))
            vocabularies.append(words)
            seen += len(words)
            starts.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])) + size if len(of) else np.zeros(0, np.int64))
            docs.append(w.doc[first] + at)
            at, size = at + part.num_rows, size + len(of)
        none = [np.zeros(0, np.int64)]
        known = pa.concat_arrays(vocabularies or [pa.array([], pa.large_string())]).dictionary_encode()  # chunks may share words
        vocabularies.clear()
        self.codes = np.asarray(known.indices)[np.concatenate(codes or none)]
        codes.clear()
        self.n, self.starts, self.doc = at, np.concatenate(starts or none), np.concatenate(docs or none)
        self.sizes = np.diff(np.append(self.starts, size))
        blocks, words = [], known.dictionary
        for i in range(0, len(words), WORD_BLOCK):
            blocks.append(word_grams(words.slice(i, WORD_BLOCK)))
        self.grams = np.concatenate([g for g, _ in blocks] or [np.zeros(0, np.int32)])
        shift = np.cumsum([0, *(len(g) for g, _ in blocks)])
        self.begin = np.concatenate([b + k for (_, b), k in zip(blocks, shift, strict=False)] or none)
        self.many = np.diff(np.append(self.begin, len(self.grams)))

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """Of each passage, for a weight of each n-gram."""
        if not len(self.starts):
            return np.zeros(0)
        word = np.add.reduceat(weight[self.grams], self.begin) / self.many
        return np.add.reduceat(word[self.codes], self.starts) / PASSAGE + bias

    def documents(self, weight: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(self.n, float(bias))
        logits = self.logits(weight, bias)
        if len(logits):
            first = np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1]))
            out[self.doc[first]] = np.maximum.reduceat(logits, first)
        return out


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def folded(self) -> tuple[np.ndarray, float]:
        """The difference of the two logits is linear in the n-grams: a weight of each, and a bias."""
        vectors, out, bias = self.p
        return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])

    def step(self, x: Passages, rows: np.ndarray, y: np.ndarray, importance: np.ndarray) -> float:
        vectors, out, bias = self.p
        size = x.sizes[rows]
        at = np.repeat(x.starts[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        used, code = np.unique(x.codes[at], return_inverse=True)
        many = x.many[used]
        edge, cut = np.cumsum(many) - many, np.cumsum(size) - size
        blocks = np.split(np.arange(len(used)), np.flatnonzero(np.diff(edge // GRAM_BLOCK)) + 1)

        def grams(b: np.ndarray) -> np.ndarray:
            """Those of the used words at b, one word's after the other's."""
            return x.grams[np.repeat(x.begin[used[b]] - (edge[b] - edge[b[0]]), many[b]) + np.arange(many[b].sum())]

        words = np.concatenate([np.add.reduceat(vectors[grams(b)], edge[b] - edge[b[0]]) for b in blocks]) / many[:, None]
        h = np.add.reduceat(words[code], cut) / PASSAGE
        z = h @ out + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        loss = float(-(importance * np.log(p[np.arange(len(y)), y] + 1e-12)).sum())
        p[np.arange(len(y)), y] -= 1
        d = (p * importance[:, None]).astype(np.float32)
        dh = (d @ out.T) / PASSAGE
        dwords = np.stack([np.bincount(code, np.repeat(dh[:, j], size), len(used)) for j in range(WIDTH)], 1) / many[:, None]
        dvec = np.zeros((BUCKETS, WIDTH))
        for b in blocks:
            g = grams(b)
            for j in range(WIDTH):
                dvec[:, j] += np.bincount(g, np.repeat(dwords[b, j], many[b]), BUCKETS)
        self.t += 1
        for i, grad in enumerate((dvec, h.T @ d, d.sum(0))):
            grad = grad.astype(np.float32)
            self.m[i] = 0.9 * self.m[i] + 0.1 * grad
            self.v[i] = 0.999 * self.v[i] + 0.001 * grad * grad
            scale = np.sqrt(self.v[i] / (1 - 0.999**self.t))
            self.p[i] = self.p[i] - RATE * (self.m[i] / (1 - 0.9**self.t)) / (scale + RARE * scale.max())
        return loss


def fit(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Folded weights of a model of labels y (0 or 1)."""
    x = Passages(texts)
    model = Model()
    first = np.flatnonzero(np.append(True, x.doc[1:] != x.doc[:-1])) if len(x.doc) else np.zeros(0, np.int64)
    if len(first) < 2 or len(set(y[x.doc[first]].tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), -50.0
    last = np.append(first[1:], len(x.doc)) - 1
    share = np.bincount(y, minlength=2) / len(y)
    weigh = lambda rows: (0.5 / share[y[x.doc[rows]]]) / len(rows)  # noqa: E731  both classes count alike
    spread = np.unique(np.concatenate([first + (last - first) * k // (SPREAD - 1) for k in range(SPREAD)]))
    for _ in range(WARM):
        model.step(x, spread, y[x.doc[spread]], weigh(spread))
    for _ in range(ROUNDS):
        logits = x.logits(*model.folded())
        top = np.maximum.reduceat(logits, first)
        best = np.flatnonzero(logits == top[np.searchsorted(first, np.arange(len(logits)), "right") - 1])
        best = best[np.unique(x.doc[best], return_index=True)[1]]
        model.step(x, best, y[x.doc[best]], weigh(best))
    return model.folded()


def _held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in ids.to_pylist()], bool)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Broadcast weights of a model fitted on labelled documents that aren't held out, in one task."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    y = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).sort_by("doc_id")  # the fit doesn't depend on the order of arrival
            parts.clear()
            texts, y = t.column("text").combine_chunks(), np.asarray(t.column("toxic"), np.int64).clip(0, 1)
            del t
            weight, bias = fit(texts, y)
            yield pa.RecordBatch.from_arrays([pa.array([weight.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weight", "bias"])

    found = rows.repartition(1).mapInArrow(run, "weight binary, bias double").collect()
    weight, bias = (np.frombuffer(found[0][0], np.float32), found[0][1]) if found else (np.zeros(BUCKETS, np.float32), -50.0)
    return docs.sparkSession.sparkContext.broadcast((weight.astype(np.float64), bias))


def scores(texts: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    z = Passages(texts).documents(*model)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted class of every document."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = scores(part.column("text"), model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_held_out(part.column("doc_id"))), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all their columns) that aren't predicted toxic."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(scores(part.column("text"), model.value) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
