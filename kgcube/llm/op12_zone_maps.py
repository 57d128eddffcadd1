"""Centroid clustering with zone maps: vectors in Hilbert order, blocks with boxes, candidates by box distance.

Components become integers floor(64 * x). Vectors are sorted along a Hilbert curve through the AXES axes of most variance,
by a range partitioning, and packed into blocks of BLOCK neighbours with the least and greatest value of every
component. In a round a block first compares its box with the centroids: a centroid whose least distance from the
box exceeds the least of the greatest distances can't be the nearest of any vector in it. Vectors meet only the
block's candidates, in exact integers. Sums by cluster are exact too, and a task gives one row a cluster and component.

Cases. Null vectors, other lengths than 64 and null or non-finite components drop the row. Integers beyond MOST in
size are taken as MOST, so that distances fit into a long. Each row is a vector, also if it repeats another or its id; of
equal starting ids the lesser vector comes first, null ids come last. Fewer than 16 vectors give fewer centroids,
an empty table an empty result. An inertia beyond a long is null. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.store import stored
from kgcube.llm.vectors import doubles, finite, lists, matrix

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a block; axes and bits an axis of the curve, together at most 62.
BLOCK, AXES, BITS = 64, 12, 5
#: Greatest size of an integer component: squares of differences, summed over 64, stay below 2**62.
MOST = 1 << 26
#: Numbers of vectors for a partition of the curve.
PARTITION = 1 << 17


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates of so many bits, by Skilling's transformation."""
    x = points.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the excess work of rotations, from the highest bit on
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


def integers(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, most: int = MOST) -> DataFrame:
    """(vec_id, v): kept vectors as integers."""
    v = doubles("embedding")
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x * scale))))
    return embeddings.where((F.size("embedding") == dimensions) & finite(v)).select("vec_id", whole.alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ids, v, low, high) of blocks of neighbours on the curve; a stored table. Equal places are dealt by id."""
    d = vectors.select("vec_id", "v")
    dims = d.select(F.size("v").alias("n")).limit(1).collect()
    dims = dims[0]["n"] if dims else DIMENSIONS
    get = lambda i: F.get("v", F.lit(i)).cast("double")
    stats = d.agg(F.count("*").alias("n"), F.array(*(F.var_pop(get(i)) for i in range(dims))).alias("var"), F.array(*(F.min(get(i)) for i in range(dims))).alias("low"), F.array(*(F.max(get(i)) for i in range(dims))).alias("high")).first()
    if not stats["n"]:
        axes, low, wide = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    else:
        axes = np.sort(np.argsort(-np.array(stats["var"]), kind="stable")[:AXES])
        low, high = np.array(stats["low"])[axes], np.array(stats["high"])[axes]
        wide = np.maximum(high - low, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))[:, axes]
                cell = np.minimum((x - low) * (1 << BITS) / wide, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(hilbert(cell, BITS))], names=["vec_id", "v", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = matrix(batch.column("v"), np.int64), batch.column("vec_id")
            cuts = np.arange(0, len(v), block)
            ends = np.append(cuts[1:], len(v))
            flat = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(v)).astype(np.int32) * v.shape[1]), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(cuts, ends[-1]).astype(np.int32)), ids), flat, lists(np.minimum.reduceat(v, cuts)), lists(np.maximum.reduceat(v, cuts))], names=["ids", "v", "low", "high"])

    kind = dict(d.dtypes)["vec_id"]
    curve = d.mapInArrow(place, f"vec_id {kind}, v array<long>, place long")
    mix = F.xxhash64("vec_id")
    curve = curve.repartitionByRange(max(1, -(-stats["n"] // PARTITION)), "place", mix).sortWithinPartitions("place", mix)
    return stored(curve.mapInArrow(pack, f"ids array<{kind}>, v array<long>, low array<long>, high array<long>"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box, which centroids can be the nearest (also by a tie) of a vector in it."""
    c = centroids[None]
    near = np.maximum(np.maximum(low[:, None] - c, c - high[:, None]), 0)
    far = np.maximum(np.abs(c - low[:, None]), np.abs(c - high[:, None]))
    least, most = (near * near).sum(2), (far * far).sum(2)
    return least <= most.min(1, keepdims=True)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centroid, the first of several, in exact integers."""
    small = max(np.abs(v).max(), np.abs(centroids).max()) < 1 << 22  # then doubles are exact
    if small:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at].astype(np.int64)


def assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, cluster, distance) of the vectors of a batch of blocks: blocks with the same candidates together."""
    can = candidates(matrix(batch.column("low"), np.int64), matrix(batch.column("high"), np.int64), centroids)
    sizes = batch.column("ids").value_lengths().to_numpy()
    v = batch.column("v").flatten().to_numpy().reshape(int(sizes.sum()), -1)
    sets, which = np.unique(can, axis=0, return_inverse=True)
    of = np.repeat(which.ravel(), sizes)
    for s, mask in enumerate(sets):
        rows, ids = np.flatnonzero(of == s), np.flatnonzero(mask)
        at, d = nearest(v[rows], centroids[ids])
        yield rows, v[rows], ids[at], d


def means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of means; clusters without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, v, cluster, _ in assigned(batch, centroids):
                    for k in np.unique(cluster):
                        total[k] += v[cluster == k].sum(0)
                    n += np.bincount(cluster, minlength=len(n))
        k, i = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total.ravel()), pa.array(n[k])], names=["k", "i", "total", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    new = centroids.copy()
    for r in table.mapInArrow(sums, "k long, i long, total long, n long").groupBy("k", "i").agg(exact("total"), exact("n")).collect():  # a row a cluster and component
        if int(r["n"]):
            new[r["k"], r["i"]] = int(r["total"]) // int(r["n"])
    return new


def clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK, watch: Callable[[np.ndarray], None] = lambda c: None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector. ``watch`` sees the centroids of each round."""
    spark = embeddings.sparkSession
    vectors = stored(integers(embeddings))
    kind = dict(vectors.dtypes)["vec_id"]
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        none = ", ".join((f"vec_id {kind}", "cluster int", "distance long", "cluster_inertia long", "inertia long", "centroid_sha256 string"))
        return spark.createDataFrame([], none)
    table = blocks(vectors, block)
    for _ in range(rounds):
        watch(centroids)
        centroids = means(table, centroids)
    watch(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("ids").flatten()
                for rows, _, cluster, distance in assigned(batch, centroids):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = stored(table.mapInArrow(label, f"vec_id {kind}, cluster int, distance long"))
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row a cluster
    fits = lambda x: int(x) if x < 1 << 63 else None
    whole = fits(sum(r["d"] for r in inertia))
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(r["cluster"], fits(r["d"]), whole, sha(r["cluster"])) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def _sql() -> str:
    parts = ["""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 16))"""]  # fmt: skip
    for i in range(4):
        parts.append(f"a{i} AS (SELECT vec_id, v, min(k * 1 + 16 * d) % 16 AS k, min(16 * d + k) // 16 AS d FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM v, c{i}) GROUP BY vec_id, v)")
        if i < 3:
            parts.append(f"m{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY k, j), c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n, c) AS c FROM c{i} LEFT JOIN (SELECT k AS kk, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS n FROM m{i} GROUP BY k) ON k = kk)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(a3.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.k = c3.k"""


SQL = _sql()
