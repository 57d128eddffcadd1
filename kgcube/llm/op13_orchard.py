"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

Components become integers floor(1024 * x); a vector is cut into 4 equal parts, each coded by an entry of its position's
codebook. For a codebook there is, for each entry, the list of all entries by distance from it. A search stands at an
entry and goes along its list; a nearer entry makes it jump to that entry's list, entries met before are marked
and not compared again, and an entry further from the current one than twice the current distance ends it, as
no later one can be nearer (nor, being strictly further, tie). All parts of a batch search side by side, STEP places of
their lists at a time, in exact integers. Codebooks follow in rounds of exact sums by entry.

Cases. Null vectors and null or non-finite components drop the row. Integers beyond MOST in size are taken as MOST. Vectors
that are empty, whose length isn't a multiple of 4 or differs from that of the smallest id's, have a null code and
error and don't train. Each row is a vector, also if it repeats another or its id; of equal starting ids the lesser
vector comes first, null ids come last. Fewer than 256 vectors give smaller codebooks, an empty table an empty result.
Null labels share one sum; a label without any code, or a sum beyond a long, has a null one. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.store import stored
from kgcube.llm.vectors import doubles, finite, looked_up, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Greatest size of an integer component: sums of squared differences over 2**8 components fit a long.
MOST = 1 << 26
#: Places of a list that a search goes along at once, and searches side by side.
STEP, SIDE = 16, 4096


class Lists:
    """A codebook with, for each entry, all entries by distance from it (itself first), and these distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        d = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        np.fill_diagonal(d, -1)
        self.order = np.argsort(d, axis=1, kind="stable")
        self.distance = np.maximum(np.take_along_axis(d, self.order, 1), 0)


def search(lists: Lists, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each row, the first of several; and the number of comparisons."""
    n, k = len(x), len(lists.entries)
    small = max(np.abs(x).max(initial=0), np.abs(lists.entries).max()) < 1 << 10 and x.shape[1] <= 256
    x, entries = (a.astype(np.int32 if small else np.int64) for a in (x, lists.entries))
    order = np.pad(lists.order, ((0, 0), (0, -k % STEP)), constant_values=0)
    distance = np.pad(lists.distance, ((0, 0), (0, -k % STEP)), constant_values=np.iinfo(np.int64).max)
    at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = ((x - entries[0]) ** 2).sum(1).astype(np.int64)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    open_, compared = np.arange(n), n
    far = np.iinfo(np.int64).max
    while len(open_):
        rows, here = open_[:, None], at[open_]
        cols = place[open_][:, None] + np.arange(STEP)
        e, apart = order[here[:, None], cols], distance[here[:, None], cols]
        in_reach = apart <= 4 * best[open_][:, None]
        new = in_reach & ~seen[rows, e]
        r, c = np.nonzero(new)
        d = np.full(e.shape, far)
        diff = x[open_[r]] - entries[e[r, c]]
        d[r, c] = np.einsum("ij,ij->i", diff, diff)
        seen[open_[r], e[r, c]] = True
        compared += len(r)
        # the least distance, of ties the least index
        least = d.min(1)
        index = np.where(d == least[:, None], e, k).min(1)
        better = (least < best[open_]) | ((least == best[open_]) & (index < here))
        moved = open_[better]
        at[moved], best[moved], place[moved] = index[better], least[better], 0
        stay = ~better
        place[open_[stay]] += STEP
        go_on = better | (in_reach[:, -1] & (place[open_] < k))
        open_ = open_[go_on]
    return at, best, compared


def encode(books: list[Lists], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a column a part) and squared distances of the parts of vectors."""
    wide = v.shape[1] // len(books)
    codes, errors = np.empty((len(v), len(books)), np.int64), np.empty((len(v), len(books)), np.int64)
    for start in range(0, len(v), SIDE):
        for p, book in enumerate(books):
            at, best, _ = search(book, v[start : start + SIDE, p * wide : (p + 1) * wide])
            codes[start : start + SIDE, p], errors[start : start + SIDE, p] = at, best
    return codes, errors


def integers(embeddings: DataFrame, scale: int = SCALE, most: int = MOST) -> DataFrame:
    v = doubles("embedding")
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x * scale))))
    return embeddings.where(F.col("embedding").isNotNull() & finite(v)).select("vec_id", "label", whole.alias("v"))


def means(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks (part, entry, position): exact floors of means; entries without parts stay."""
    shared = table.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, wide = shared.value.shape
        lists = [Lists(b) for b in shared.value]
        total, n = np.zeros((parts * k, wide), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), np.int64)
                codes, _ = encode(lists, v)
                for p in range(parts):
                    slot = p * k + codes[:, p]
                    np.add.at(total, slot, v[:, p * wide : (p + 1) * wide])
                    n += np.bincount(slot, minlength=len(n))
        slot, i = np.divmod(np.arange(total.size), wide)
        used = n[slot] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (slot, i, total.ravel(), n[slot])], names=["slot", "i", "total", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    new = books.copy()
    flat = new.reshape(-1, books.shape[2])
    for r in table.select("v").mapInArrow(sums, "slot long, i long, total long, n long").groupBy("slot", "i").agg(exact("total"), exact("n")).collect():  # a row a component of the codebooks
        flat[r["slot"], r["i"]] = int(r["total"]) // int(r["n"])
    return new


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row with a usable vector."""
    spark = embeddings.sparkSession
    vectors = stored(integers(embeddings))
    kind, label_kind = dict(vectors.dtypes)["vec_id"], dict(vectors.dtypes)["label"]
    fit = (F.size("v") > 0) & (F.size("v") % parts == 0)
    first = vectors.where(fit).orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    table = vectors.where(F.size("v") == (width or -1))
    start = table.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2) if start else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if start else 0):
        books = means(table, books)
    shared = spark.sparkContext.broadcast(books)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Lists(b) for b in shared.value]
        for batch in batches:
            if batch.num_rows:
                found, errors = encode(lists, matrix(batch.column("v"), np.int64))
                text = found.astype(np.uint8).tobytes().hex()
                n = 2 * found.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i : i + n] for i in range(0, len(text), n)]), pa.array(errors.sum(1))], names=["vec_id", "label", "code", "error"])

    coded = table.mapInArrow(label, f"vec_id {kind}, label {label_kind}, code string, error long") if start else table.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    other = vectors.where(F.size("v") != (width or -1)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = stored(coded.unionByName(other).withColumns({"key": F.coalesce(F.col("label").cast("string"), F.lit("")), "none": F.col("label").isNull()}))
    by_label = stored(rows.groupBy("key", "none").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return looked_up(rows, by_label, ["key", "none"], by_label.count()).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql() -> str:
    parts = ["""w AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM w, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS k, x AS c FROM x JOIN (SELECT r, vec_id, v FROM w ORDER BY vec_id, v LIMIT 256) USING (r))"""]  # fmt: skip
    for i in range(5):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(d * 256 + k) % 256 AS k, min(d * 256 + k) // 256 AS d FROM (SELECT r, p, x, k, list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS d FROM x JOIN c{i} USING (p)) GROUP BY r, p)")
        if i < 4:
            parts.append(f"m{i} AS (SELECT p, k, j, sum(y) AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY ALL), c{i + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(n, c) AS c FROM c{i} c LEFT JOIN (SELECT p, k, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS n FROM m{i} GROUP BY p, k) z ON c.p = z.p AND c.k = z.k)")
    return "WITH " + ",\n".join(parts) + """,
e AS (SELECT r, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c4) AS codebooks_sha256 FROM w JOIN e USING (r)"""


SQL = _sql()
