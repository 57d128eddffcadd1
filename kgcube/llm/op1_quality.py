"""Quality rules with robust multivariate outliers.

Each document has a vector of transformed statistics. Per language and source a minimum covariance
determinant (MCD) estimate of centre and scatter is fitted by concentration steps, and documents whose
Mahalanobis distance from it is too large are rejected, besides those that fail the base rules.

The steps run as aggregations, so a source with a third of all rows is no single task: distances are
binned on a logarithmic scale, each (group, bin) has additive moments, and the half-set of a step is
the run of nearest bins that holds the share ``ALPHA`` of the group. There are three deterministic starts, all
centred on the medians and scaled by the quartiles, which histograms give in the same way: no correlation, that of
the hyperbolic tangents of the scaled statistics, and that of their spatial signs. After ``TRIALS`` steps the
start with the least determinant goes on. All rows that pass the base rules take part; nothing is sampled.

Defined cases: a null text has no words and fails the base rules; null language or source is a group
of its own; sources with fewer than ``least`` documents of a language share one estimate for that
language, and languages with fewer still share one for all, as no scatter of six statistics can be told from a
handful of documents; each statistic has the noise in ``FLOOR`` besides its scatter in a group, so that ties
don't make that singular and a group of like documents isn't judged by trifles; repeated rows count each time; other columns, whatever their names, are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgcube.llm.words import Words, chunks, covered, gram_hashes, mix, whole

#: log words, characters a word, and roots of the shares of symbols, repeated lines, repeated windows and short words
FEATURES = ("f0", "f1", "f2", "f3", "f4", "f5")
D = len(FEATURES)
#: Standard deviation of the noise that each feature is taken to have besides its scatter.
FLOOR = (0.5, 0.5, 0.06, 0.08, 0.08, 0.05)
ALPHA, LEAST = 0.75, 60
#: Concentration steps of each start, and of the best one after them.
TRIALS, STEPS = 2, 4
STARTS = 3
#: Least eigenvalue of a correlation matrix.
RIDGE = 0.02
#: Rows beyond this quantile of the chi-squared distribution are rejected.
QUANTILE = 0.99999
#: Group tables of at most so many rows are broadcast.
BROADCAST_GROUPS = 20_000

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(w: Words, codes: np.ndarray, k: int = 5) -> np.ndarray:
    """Which words lie in a k-word window that its text has twice or more."""
    at = whole(w, k)
    if not len(at):
        return np.zeros(len(w), bool)
    with np.errstate(over="ignore"):
        key = mix(gram_hashes(codes.astype(np.uint64), k)[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = at[order[same]], at[order[same + 1]]
    ok = w.doc[a] == w.doc[b]
    for j in range(k):
        ok &= codes[a + j] == codes[b + j]
    return covered(len(w), np.unique(np.concatenate([a[ok], b[ok]])), k)


def repeated_lines(w: Words, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, for each of n texts."""
    cut = np.union1d(np.flatnonzero(w.data == 10) + 1, w.offsets)  # a line and its end
    if len(cut) < 2:
        return np.zeros(n, np.int64)
    starts, ends = cut[:-1], cut[1:].copy()
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    closed = w.data[ends - 1] == 10
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[has], (ends - closed)[has], doc[has]
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    data = w.data[np.cumsum(inside[:-1]) > 0]
    off = np.concatenate(([0], np.cumsum(ends - starts)))
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    key = np.asarray(lines.dictionary_encode().indices, np.int64) + doc * (len(starts) + 1)
    first = np.unique(key, return_index=True)[1]
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    n = len(texts)
    w = Words(texts)
    codes, _ = w.codes()
    begins = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # code points before each byte
    length = begins[w.ends] - begins[w.starts]
    chars = np.bincount(w.doc, length, minlength=n).astype(np.int64)
    short = np.bincount(w.doc, length <= 3, minlength=n)
    total = np.concatenate(([0], np.cumsum(_SYMBOL[w.data])))
    symbols = total[w.offsets[1:]] - total[w.offsets[:-1]]
    again = np.bincount(w.doc[repeated(w, codes)], minlength=n).astype(np.int64)
    lines = repeated_lines(w, n)
    words = w.counts
    of = np.maximum(words, 1)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": symbols.astype(np.int64), "n_dup_lines": lines.astype(np.int64), "n_repeat_words": again,
        "base_failed": (words < 10) | (100 * again > 20 * words),
        "f0": np.log1p(words), "f1": chars / of, "f2": np.sqrt(symbols / np.maximum(chars, 1)), "f3": np.sqrt(lines / of), "f4": np.sqrt(again / of), "f5": np.sqrt(short / of),
    }


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(v) for v in s.values())], names=["doc_id", "lang", "source", *s])

    at = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("long"), *at, "text").mapInArrow(run, STATS)


def chi2_quantile(q: float, d: int) -> float:
    """By bisection on the series of the regularised incomplete gamma function."""

    def cdf(x: float) -> float:
        a, t = d / 2, x / 2
        term = total = 1 / a
        for i in range(1, 2000):
            term *= t / (a + i)
            total += term
        return total * math.exp(a * math.log(t) - t - math.lgamma(a))

    lo, hi = 1e-9, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return lo


def consistency() -> float:
    """What the scatter of the nearest ALPHA of normal rows must be multiplied by."""
    q = chi2_quantile(ALPHA, D)
    lo, hi = 0.0, 1.0
    for _ in range(100):  # cdf of D + 2 degrees at q
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, D + 2) < q else (lo, mid)
    return ALPHA / lo


def effective_groups(stats: DataFrame, least: int) -> DataFrame:
    """(lang, source) -> group: itself, or the rest of its language, or the rest of all."""
    n = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.to_json(F.array("lang", "source"))
    rest = F.sum(F.when(F.col("n") < least, F.col("n"))).over(W.partitionBy("lang"))
    level = F.when(F.col("n") >= least, own).when(rest >= least, F.to_json(F.array("lang"))).otherwise("[]")
    return n.select("lang", "source", level.alias("g"))


PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _moments(x: list, prefix: str = "") -> list:
    return [F.sum(v).alias(f"{prefix}s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"{prefix}q{i}_{j}") for i, j in PAIRS]


PARAMS = "g string, start int, " + ", ".join([f"c{i} double" for i in range(D)] + [f"p{i}_{j} double" for i, j in PAIRS]) + ", logdet double"


def _scatter(r: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from moments."""
    mu, cov = np.array([r[f"{prefix}s{i}"] for i in range(D)]) / r["m"], np.zeros((D, D))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = r[f"{prefix}q{i}_{j}"] / r["m"] - mu[i] * mu[j]
    return mu, cov


def _correlation(cov: np.ndarray) -> np.ndarray:
    """Positive definite, whatever the covariance."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = cov / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    w, v = np.linalg.eigh(r)
    return (v * np.maximum(w, RIDGE)) @ v.T


def _row(g: str, start: int, mu: np.ndarray, sd: np.ndarray, r: np.ndarray) -> list:
    cov = r * np.outer(sd, sd)
    p = np.linalg.inv(cov)
    return [g, start, *mu, *(p[i, j] for i, j in PAIRS), float(np.linalg.slogdet(cov)[1])]


def _params(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PARAMS.split(", ")])


def _starts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for r in pdf.to_dict("records"):
            mid, sd = (np.array([r[f"{x}{i}"] for i in range(D)]) for x in ("mid", "sd"))
            rows += [_row(r["g"], k, mid, sd, c) for k, c in enumerate([np.eye(D), *(_correlation(_scatter(r, x)[1]) for x in ("t", "u"))])]
        yield _params(rows)


def _estimates(scale: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                mu, cov = _scatter(r)
                cov = cov * scale + np.diag(np.square(FLOOR))
                rows.append(_row(r["g"], r["start"], mu, np.sqrt(np.diag(cov)), _correlation(cov)))
            yield _params(rows)

    return run


def _distance():
    x = [F.col(f) - F.col(f"c{i}") for i, f in enumerate(FEATURES)]
    return reduce(lambda a, b: a + b, ((1 if i == j else 2) * x[i] * x[j] * F.col(f"p{i}_{j}") for i, j in PAIRS))


def _near(rows: DataFrame) -> DataFrame:
    """Moments of the nearest ALPHA of each group and start; rows have their distance in ``d2``."""
    key = ["g", "start"]
    bins = rows.withColumn("b", F.floor(F.log2(F.greatest("d2", F.lit(1e-6))) * 32)).groupBy(*key, "b").agg(F.count("*").cast("double").alias("m"), *_moments([F.col(f) for f in FEATURES]))
    before = F.sum("m").over(W.partitionBy(*key).orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("m").over(W.partitionBy(*key))
    kept = bins.withColumn("before", F.coalesce(before, F.lit(0.0))).withColumn("total", total).where(F.col("before") < ALPHA * F.col("total"))
    names = [c for c in bins.columns if c not in (*key, "b")]
    return kept.groupBy(*key).agg(*(F.sum(c).alias(c) for c in names))


def _middle(rows: DataFrame) -> DataFrame:
    """Median and scale of each feature of each group."""
    step = 64.0
    long = rows.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f) * step).alias("v")) for i, f in enumerate(FEATURES)))).alias("x"))
    n = long.groupBy("g", "x.i", "x.v").agg(F.count("*").alias("n"))
    w = W.partitionBy("g", "i")
    cum = n.withColumn("cum", F.sum("n").over(w.orderBy("v"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("v"))) / step
    per = cum.groupBy("g", "i").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    out = per.groupBy("g").pivot("i", list(range(D))).agg(F.first("mid").alias("mid"), F.first(F.col("hi") - F.col("lo")).alias("iqr"))
    return out.select("g", *(F.col(f"{i}_mid").alias(f"mid{i}") for i in range(D)), *(F.greatest(F.col(f"{i}_iqr") / 1.349, F.lit(float(FLOOR[i]))).alias(f"sd{i}") for i in range(D)))


def _first(rows: DataFrame, hint) -> DataFrame:
    """Parameters of the three starts of each group."""
    middle = _middle(rows)
    z = [(F.col(f) - F.col(f"mid{i}")) / F.col(f"sd{i}") for i, f in enumerate(FEATURES)]
    norm = F.sqrt(reduce(lambda a, b: a + b, (v * v for v in z)))
    signs = [F.when(norm > 0, v / norm).otherwise(0.0) for v in z]
    names = [f"{x}{i}" for x in ("mid", "sd") for i in range(D)]
    per = rows.join(hint(middle), "g").groupBy("g").agg(F.count("*").cast("double").alias("m"), *(F.first(c).alias(c) for c in names), *_moments([F.tanh(v) for v in z], "t"), *_moments(signs, "u"))
    return per.mapInPandas(_starts, PARAMS)


def judge(stats: DataFrame, stored, least: int = LEAST) -> DataFrame:
    """stats plus the distance and ``kept``; stats should be a stored table, as it is read several times."""
    groups = stored(effective_groups(stats, least))
    small = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else (lambda x: x)
    with_text = lambda df: df.withColumns({c: F.coalesce(F.to_json(F.array(c)), F.lit("")) for c in ("lang", "source")})
    rows = with_text(stats).join(hint(with_text(groups)), ["lang", "source"], "left")
    good = rows.where(~F.col("base_failed")).select("g", *FEATURES)
    params = stored(_first(good, hint))
    for step in range(TRIALS + STEPS):
        if step == TRIALS:  # the start with the least determinant goes on
            best = params.groupBy("g").agg(F.min_by(F.struct(*params.columns[1:]), F.struct("logdet", "start")).alias("x"))
            params = best.select("g", "x.*")
        near = _near(good.join(hint(params), "g").withColumn("d2", _distance()))
        params = stored(near.mapInPandas(_estimates(1.0 if step < TRIALS + STEPS - 1 else consistency()), PARAMS))
    d2 = _distance()
    cut = chi2_quantile(QUANTILE, D)
    out = rows.join(hint(params), "g", "left").withColumn("distance2", d2)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True)))


def quality(docs: DataFrame, stored, least: int = LEAST) -> DataFrame:
    """Base counts, distance and verdict of every document; ``stored`` writes a table and rereads it, and ``least``
    is the number of documents from which on a source of a language has an estimate of its own."""
    out = judge(stored(document_statistics(docs)), stored, least)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
