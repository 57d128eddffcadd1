"""Language-model scoring with a gated recurrent network.

Word counts of all training documents give the base score. The ``VOCABULARY`` most frequent words, the
end and one id for all other words are the network's vocabulary; a word outside it has the
probability of that id, given the state, times its share among such words. The network's state starts
anew with each document and is carried across windows, so a document's score is the likelihood of all
of it, however long.

Every training document is trained on, once. Tasks of ``TASK_TOKENS`` tokens each train copies of the network
on their documents by truncated backpropagation and the copies are averaged, weighted by tokens, after each
of four rounds that grow from a sixty-fourth of the documents to most of them. Round, task and order of a document
hang on a hash of its id and text, so neither the size of the cluster nor how the input is split changes the network,
and a task that is run again trains the same copy. Counts of the ``HEAD`` most frequent
words are broadcast; other words, none of them frequent, are joined with the table of counts.

Defined cases: a null text is empty and has the end as its only token; a null doc_id counts as an empty
text in the choice of held-out documents; repeated rows are scored, and counted, each; other columns, whatever
their names, are not read; an empty table gives an empty table; if no document is left to train on, every token
is unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.gru import Model
from kgcube.llm.words import Words, chunks

VOCABULARY, HEAD = 1000, 150_000
#: Tokens of a training task, and documents it takes up at a time.
TASK_TOKENS, TRAIN_DOCS = 2_000_000, 1024
#: Shares of the training documents, in sixty-fourths, up to which the rounds go.
ROUNDS = (1, 4, 16, 64)
#: Counts of words that a task holds to look those of rare words up.
JOINED = 200_000
#: Parameters that are averaged together.
PIECE = 1024
END = ""

ENCODED = "rid long, key long, doc_id long, held_out boolean, round int, ids binary, n_tokens long, head_known long, head_base double, head_rare double, tail array<struct<word:string,n:int>>"
SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_rare double, lm double"


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids.to_pylist()], bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) in training documents; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.filter(pa.array(~held_out(batch.column("doc_id"))))):
                codes, words = Words(part.column("text"), lower=True).codes()
                n = np.append(np.bincount(codes, minlength=len(words)), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.large_string())]).cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    one = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return one.groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """What is broadcast: counts of frequent words, the totals, and the network's ids."""

    def __init__(self, words: list[str], counts: list[int], tokens: int, distinct: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts = [words[i] for i in order], np.array([counts[i] for i in order], np.int64)
        self.tokens, self.distinct = tokens, distinct
        own = [i for i, w in enumerate(self.words) if w != END][:VOCABULARY]
        self.end, self.rare = len(own), len(own) + 1
        self.id = np.full(len(self.words), self.rare, np.int64)
        self.id[own] = np.arange(len(own))
        at = self.words.index(END) if END in self.words else None
        ends = int(self.counts[at]) if at is not None else 0
        if at is not None:
            self.id[at] = self.end
        self.rare_tokens = tokens - int(self.counts[own].sum()) - ends
        self.rare_types = distinct - len(own) - (at is not None)
        self.n_end = ends
        self.model_counts = np.append(self.counts[own], [max(ends, 1), max(self.rare_tokens, 1)]).astype(float)

    def base(self, c):
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def among_rare(self, c):
        return np.log10((c + 0.1) / (self.rare_tokens + 0.1 * (self.rare_types + 1)))


def lexicon(counts: DataFrame) -> Lexicon:
    """The frequent words: all with a count above a bound that at most HEAD of them pass."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True)
    least, total = None, 0
    for r in sizes:
        total += r.k
        if total > HEAD:
            break
        least = r.level
    rows = counts.where((level >= (1 << 20 if least is None else least)) | (F.col("word") == END)).collect()
    return Lexicon([r.word for r in rows], [r.n for r in rows], tokens, distinct)


def encode(docs: DataFrame, lex) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = lex.value
        value_set = pa.array(x.words, pa.large_string())
        ids = np.append(x.id, x.rare).astype("<i2")
        base_of, rare_of = np.append(x.base(x.counts), 0.0), np.append(np.where(x.id == x.rare, x.among_rare(x.counts), 0.0), 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"), lower=True)
                codes, words = w.codes()
                at = np.asarray(pc.fill_null(pc.index_in(words, value_set=value_set), len(x.words)), np.int64)
                word = at[codes] if len(codes) else codes
                head = word < len(x.words)
                n = part.num_rows
                total = lambda v: np.bincount(w.doc, v, minlength=n)
                base, rare, known = total(base_of[word]) + x.base(x.n_end), total(rare_of[word]), np.bincount(w.doc[head], minlength=n) + (x.n_end > 0)
                pairs, times = np.unique(w.doc[~head] * len(words) + codes[~head], return_counts=True)
                own, other = np.divmod(pairs, max(len(words), 1))
                tails = pa.StructArray.from_arrays([words.take(pa.array(other)).cast(pa.string()), pa.array(times, pa.int32())], names=["word", "n"])
                edges = np.searchsorted(own, np.arange(n + 1)).astype(np.int32)
                tokens = np.full(len(word) + n, x.end, "<i2")  # each text is followed by the end
                tokens[np.arange(len(word)) + w.doc] = ids[word]
                ends = ((w.first + np.arange(n + 1)) * 2).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
                held = held_out(part.column("doc_id"))
                rid = row + np.arange(n)
                row += n
                bucket = np.asarray(part.column("key"), np.int64) % ROUNDS[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), part.column("key"), part.column("doc_id"), pa.array(held), pa.array(np.where(held, -1, np.searchsorted(ROUNDS, bucket, "right")).astype(np.int32)), raw, pa.array(w.counts + 1), pa.array(known), pa.array(base), pa.array(rare), pa.ListArray.from_arrays(pa.array(edges), tails)],
                    names=["rid", "key", "doc_id", "held_out", "round", "ids", "n_tokens", "head_known", "head_base", "head_rare", "tail"],
                )

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return own.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(run, ENCODED)


def token_ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i2").astype(np.int64) for b in batch.column("ids").to_pylist()]


def train(encoded: DataFrame, lex: Lexicon) -> np.ndarray:
    """Parameters after the rounds."""
    spark = encoded.sparkSession
    flat = Model(lex.model_counts, lex.end).flat()
    counts, end = lex.model_counts, lex.end
    sizes = dict(encoded.groupBy("round").agg(F.sum("n_tokens")).collect())
    for k in range(len(ROUNDS)):
        tokens = sizes.get(k, 0)
        if not tokens:
            continue
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            model, seen, waiting = Model(counts, end).load(start.value), 0, []
            for batch in batches:
                waiting += token_ids(batch)
                while len(waiting) >= TRAIN_DOCS:
                    seen += sum(map(len, waiting[:TRAIN_DOCS]))
                    model.train(waiting[:TRAIN_DOCS])
                    waiting = waiting[TRAIN_DOCS:]
            if waiting:
                seen += sum(map(len, waiting))
                model.train(waiting)
            if seen:
                own = model.flat()
                pieces = [own[i : i + PIECE].astype("<f4").tobytes() for i in range(0, len(own), PIECE)]
                task = [TaskContext.get().partitionId()] * len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(task, pa.int32()), pa.array([float(seen)] * len(pieces)), pa.array(pieces, pa.binary())], names=["piece", "task", "weight", "w"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}  # one row of each copy comes after the other; only sums are held
            for batch in batches:
                for piece, weight, w in zip(*(batch.column(c).to_pylist() for c in ("piece", "weight", "w")), strict=True):
                    x = total.setdefault(piece, [0.0, 0.0])
                    x[0] += weight
                    x[1] = x[1] + weight * np.frombuffer(w, "<f4").astype(np.float64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(x / n).astype("<f4").tobytes() for n, x in total.values()], pa.binary())], names=["piece", "w"])

        tasks = int(max(1, -(-tokens // TASK_TOKENS)))
        dealt = encoded.where(F.col("round") == k).select("key", "ids").repartition(tasks, "key").sortWithinPartitions("key", "ids")
        copies = dealt.select("ids").mapInArrow(run, "piece int, task int, weight double, w binary")
        parts = copies.repartition("piece").sortWithinPartitions("piece", "task").mapInArrow(mean, "piece int, w binary").collect()
        flat = np.concatenate([np.frombuffer(w, "<f4") for _, w in sorted(map(tuple, parts))])
    return flat


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    from kgcube.llm.store import stored

    sc = docs.sparkSession.sparkContext
    counts = stored(word_counts(docs))
    lex = lexicon(counts)
    shared = sc.broadcast(lex)
    encoded = stored(encode(docs, shared))
    flat = sc.broadcast(train(encoded, lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value.model_counts, shared.value.end).load(flat.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.drop_columns(["ids"]).append_column("lm", pa.array(model.score(token_ids(batch)) / np.log(10)))

    names = [x.split()[0] for x in SCORED.split(", ")]
    scored = encoded.select(*names[:4], "head_known", "head_base", "head_rare", "ids").mapInArrow(run, SCORED)
    tail = encoded.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.word").alias("word"), F.col("t.n").alias("k"))
    parts = int(lex.distinct // JOINED + 1)  # so a part's counts fit into a hash table; no word in the tail is frequent
    tail = tail.repartition(parts, "word").join(counts.repartition(parts, "word").hint("shuffle_hash"), "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1)
    tail = tail.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("k") * F.log10(c / F.lit(lex.tokens + 0.1 * (lex.distinct + 1)))).alias("tail_base"),
        F.sum(F.col("k") * F.log10(c / F.lit(lex.rare_tokens + 0.1 * (lex.rare_types + 1)))).alias("tail_rare"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).alias("n_known"), F.lit(int(lex.tokens)).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("tail_base")).alias("base_score"), (F.col("lm") + F.col("head_rare") + zero("tail_rare")).alias("score"),
    )
