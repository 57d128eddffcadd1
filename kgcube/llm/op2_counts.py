"""Token counts as rollups that are maintained by deltas.

Batches carry signed rows: an insert adds a document and its tokens, a delete takes them away, and a
revised count takes the old tokens away and adds the new ones. A batch is summed by source, language
and tokenizer version and committed under its id; committing an id again changes nothing, so a batch
may be delivered any number of times.

Totals are a stored table, the base, that holds the sums of all batches but the latest ones. A commit writes the
batch's sums; every ``FOLD`` commits, the waiting batches are added to the base, whose next version names the
batches in it, so reading the totals never goes back to what was committed long ago. A batch, or a version of
the base, counts when Spark's committer has left its success mark; what a lost driver left without the mark is
overwritten by the next attempt, and a batch that is both in the base and still there counts once. There is one
writer at a time. Sums by key are combined before the shuffle, so a source with a third of all rows is no
large group.

Defined cases: null source or language is a key of its own; a null text has no tokens but is a document;
repeated rows count each time; an empty batch commits no rows; keys whose documents and tokens are all
taken away leave the totals; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgcube.llm.store import delete, exists, stored
from kgcube.llm.words import NOT_ALNUM, WHITE, Words, chunks

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Commits after which waiting batches are added to the base.
FOLD = 8
#: Tokenizer versions: words between white space; runs of digits and letters.
WHITE_1, ALNUM_1 = "white-1", "alnum-1"
MARKS = b"#*$%&|<>!"


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, fold: int = FOLD):
        self.spark, self.root, self.fold = spark, root.rstrip("/"), fold

    def _names(self, kind: str) -> list[str]:
        """Of finished folders root/kind/name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [n for n in found if exists(self.spark, f"{self.root}/{kind}/{n}/_SUCCESS")]

    def base(self) -> int:
        """Version of the base; 0 is the empty one."""
        return max((int(n) for n in self._names("base")), default=0)

    def folded(self, version: int) -> DataFrame:
        """(batch) that are in the base."""
        return self.spark.read.schema("batch string").parquet(f"{self.root}/folded/{version}") if version else self.spark.createDataFrame([], "batch string")

    def waiting(self, version: int) -> list[str]:
        """Committed batches that aren't in the base: fewer than ``fold``, and those left by a lost driver."""
        names = self._names("batch")
        known = {r.batch for r in self.folded(version).where(F.col("batch").isin(names)).collect()} if version and names else set()
        return sorted(set(names) - known)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False if it was committed before."""
        folder, version = f"{self.root}/batch/{batch}", self.base()
        if exists(self.spark, f"{folder}/_SUCCESS") or not self.folded(version).where(F.col("batch") == batch).isEmpty():
            return False
        summed(deltas).write.mode("overwrite").parquet(folder)
        if len(self.waiting(version)) >= self.fold:
            self.compact()
        return True

    def compact(self) -> None:
        """Add the waiting batches to the base."""
        version = self.base()
        names = self.waiting(version)
        if not names:
            return
        new = self.spark.createDataFrame([(n,) for n in names], "batch string")
        self.folded(version).unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folded/{version + 1}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/base/{version + 1}")
        for n in names:
            delete(self.spark, f"{self.root}/batch/{n}")
        for kind in ("base", "folded"):
            delete(self.spark, f"{self.root}/{kind}/{version - 1}")

    def totals(self) -> DataFrame:
        version = self.base()
        folders = [f"{self.root}/batch/{n}" for n in self.waiting(version)] + [f"{self.root}/base/{version}"] * bool(version)
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return summed(self.spark.read.schema(DELTA).parquet(*folders)).where("n_docs <> 0 or n_tokens <> 0")


def inserts(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col(tokens).alias("n_tokens"))


def deletes(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return inserts(counts, tokenizer, tokens).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(counts: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang and the counts white, plain (white, without marks) and alnum."""
    marks = np.zeros(256, bool)
    marks[list(MARKS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                text = part.column("text")
                w = Words(text, WHITE)
                real = np.append(0, np.cumsum(w.inside & ~marks[w.data]))
                plain = np.bincount(w.doc[real[w.ends] > real[w.starts]], minlength=part.num_rows).astype(np.int64)
                alnum = Words(text, NOT_ALNUM, lower=True).counts
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(w.counts), pa.array(plain), pa.array(alnum)], names=["doc_id", "source", "lang", "white", "plain", "alnum"])

    schema = "doc_id long, source string, lang string, white long, plain long, alnum long"
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, schema)


def maintained(docs: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """Totals after a run of batches: all documents come in, under two tokenizers; the counts of white-1
    are revised to leave out words of marks only; toxic documents go; batches are delivered twice."""
    counts = stored(token_counts(docs))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = counts.join(toxic, "doc_id", "left_semi")
    rollup = Rollup(docs.sparkSession, root)
    batches = [
        ("1-insert", inserts(counts, WHITE_1, "white").unionByName(inserts(counts, ALNUM_1, "alnum"))),
        ("2-revise", revisions(counts.where("plain <> white"), WHITE_1, "white", "plain")),
        ("3-delete", deletes(gone, WHITE_1, "plain").unionByName(deletes(gone, ALNUM_1, "alnum"))),
    ]
    for name, deltas in [*batches, *batches[1:]]:
        rollup.commit(name, deltas)
        if name == "2-revise":
            rollup.compact()
    return rollup.totals()


SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang,
         len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '[^#*$%&|<>!]'))) AS plain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS alnum
  FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
SELECT source, lang, t.tokenizer AS tokenizer, count(*) AS n_docs, CAST(sum(t.n) AS BIGINT) AS n_tokens
FROM (SELECT source, lang, unnest([{'tokenizer': 'white-1', 'n': plain}, {'tokenizer': 'alnum-1', 'n': alnum}]) AS t FROM c)
GROUP BY source, lang, t.tokenizer
"""
