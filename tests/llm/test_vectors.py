"""The operators on embeddings against plain numpy on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgcube.llm import op11_cover_tree as cover
from kgcube.llm import op12_zone_maps as zone
from kgcube.llm import op13_orchard as orchard

SCHEMA = "vec_id long, embedding array<float>, label int"
RNG = np.random.default_rng(4)


def near(centre, n, cosine):
    """Unit vectors at about the root of this cosine from the centre, so that pairs are at about the cosine."""
    x = RNG.normal(size=(n, 64))
    x -= np.outer(x @ centre, centre)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * x


def unit(n):
    x = RNG.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors():
    c = unit(3)
    plain = [v.tolist() for v in np.concatenate([unit(150), near(c[0], 120, 0.99), near(c[1], 60, 0.98), near(c[2], 40, 0.985)])]
    rows = [(i, v, None if i % 29 == 0 else i % 3 if i < 150 else i % 2) for i, v in enumerate(plain)]
    copies = [(1000 + i, plain[160], 0) for i in range(30)] + [(1100 + i, plain[160], 1) for i in range(5)] + [(1200, [3 * x for x in plain[160]], 0)]
    # nulls, non-finite and zero vectors, another length, repeated ids and rows, null ids
    odd = [(2000, None, 0), (2001, [], 0), (2002, [float("nan")] + [0.1] * 63, 0), (2003, [float("inf")] + [0.1] * 63, 0), (2004, [None] + [0.1] * 63, 0), (2005, [0.0] * 64, 0), (2006, [-0.0] * 64, 0), (2007, [0.1] * 8, 0), (2008, [0.1] * 8, 0), (7, plain[3], 1), (7, plain[3], 1), (None, plain[161], 0), (None, None, None), (2009, [1e30] * 64, 1), (2010, [1e-30] * 64, 1)]
    return rows + copies + odd


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"n": F.lit("clash"), "node": F.lit(1), "cluster": F.lit("x"), "v": F.lit(0), "grp": F.lit(0), "code": F.lit(1)})


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def single(v):
    return [float(x) for x in np.array(v, np.float32)]


def brute_links(rows, cosine=0.98):
    ok = [(i, np.array(single(r[1]))) for i, r in enumerate(rows) if r[2] is not None and usable(r[1]) and any(single(r[1]))]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(rows)
    for a, (i, u) in enumerate(ok):
        for j, v in ok[:a]:
            if rows[i][2] == rows[j][2] and len(u) == len(v) and u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    c = [least.get(root(i)) for i in range(len(rows))]
    return sorted(((r[0], n[i], c[i], r[0] is not None and r[0] == c[i]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("part", [1024, 50, 7])
def test_links(spark, vectors, part):
    got = cover.near_duplicates(table(spark, vectors), part=part)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(vectors)


def test_links_of_odd_tables(spark):
    assert cover.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, [1.0, 0.0], 1) for i in range(300)] + [(400 + i, None, 1) for i in range(5)]
    got = cover.near_duplicates(table(spark, rows), part=10).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id < 300} == {(299, 0, True), (299, 0, False)} and len(got) == 305


def test_tables_of_many_groups_need_no_broadcast(spark, vectors, monkeypatch):
    monkeypatch.setattr("kgcube.llm.vectors.MOST_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, cover.near_duplicates(table(spark, vectors), part=50).collect()), key=str) == brute_links(vectors)


def test_dual_traversal_prunes_and_links_whole():
    c = unit(20)
    points = np.concatenate([near(x, 60, 0.995) for x in c])
    root = cover.tree(points)
    i, j, leaves = cover.dual(root, root, 0.2)
    compared = sum(len(x.index) * len(y.index) for x, y in leaves)
    assert len(i) == 20 * 60 * 59 // 2 and compared < 0.2 * len(points) ** 2
    assert len(cover.within(points, None, 0.98)[0]) == len(i)
    todo = [root]
    while todo:
        n = todo.pop()
        assert (np.sqrt(((points[n.index] - n.centre) ** 2).sum(1)) <= n.radius + 1e-12).all()
        assert sorted(np.concatenate([x.index for x in n.children] or [n.index]).tolist()) == sorted(n.index.tolist())
        todo += n.children


# --- centroids ----------------------------------------------------------------------------------


def brute_clusters(rows):
    kept = [(r[0], [math.floor(64 * x) for x in single(r[1])]) for r in rows if usable(r[1]) and len(r[1]) == 64]
    kept = [(i, [max(-zone.MOST, min(zone.MOST, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:16]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(c)) for _, v in kept]

    for _ in range(3):
        at = assign()
        for k in range(len(c)):
            own = [v for (_, v), (_, j) in zip(kept, at) if j == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = [sum(d for d, j in at if j == k) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, d, total[k], sum(total), sha[k]) for (i, _), (d, k) in zip(kept, at)), key=str)


@pytest.mark.parametrize("block", [64, 3])
def test_clusters(spark, vectors, block):
    rows = [r for r in vectors if r[0] not in (2009,)] + [(3000 + i, [0.25 * (i % 3)] * 64, 1) for i in range(100)]
    got = zone.clusters(table(spark, rows), block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows)


def test_clusters_of_odd_tables(spark, vectors):
    assert zone.clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(5, [0.5] * 64, 1), (5, [0.5] * 64, 1), (6, [-0.5] * 64, None), (8, [1e30] * 64, 0)]
    assert sorted(map(tuple, zone.clusters(table(spark, few)).collect()), key=str) == brute_clusters(few)


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = zone.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_box_bounds_prune_and_lose_no_centroid():
    c = np.round(64 * unit(16)).astype(np.int64)
    v = np.concatenate([x + RNG.integers(-2, 3, (40, 64)) for x in c])
    low, high = v.reshape(16, 40, 64).min(1), v.reshape(16, 40, 64).max(1)
    can = zone.candidates(low, high, c)
    at, _ = zone.nearest(v, c)
    assert can[np.arange(len(v)) // 40, at].all() and can.sum() == 16


# --- codes --------------------------------------------------------------------------------------


def brute_codes(rows, parts=4, rounds=4):
    kept = [(r[0], r[2], [max(-orchard.MOST, min(orchard.MOST, math.floor(1024 * x))) for x in single(r[1])]) for r in rows if usable(r[1])]
    order = sorted((r for r in kept if r[2] and len(r[2]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(order[0][2]) if order else -1
    fit = [r for r in order if len(r[2]) == width]
    cut = lambda v, p: v[p * width // parts : (p + 1) * width // parts]
    books = [[cut(v, p) for *_, v in fit[:256]] for p in range(parts)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p, b in enumerate(books):
            own = {}
            for *_, v in fit:
                own.setdefault(near(cut(v, p), b)[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else e for k, e in enumerate(b)]
    out, total = [], {}
    for i, label, v in kept:
        code, error = None, None
        if len(v) == width:
            found = [near(cut(v, p), books[p]) for p in range(parts)]
            code, error = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
            total[label] = total.get(label, 0) + error
        out.append((i, label, code, error))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total.get(label), sha) for i, label, c, e in out), key=str)


def test_codes(spark, vectors):
    rows = [r for r in vectors if r[0] != 2009]
    assert sorted(map(tuple, orchard.codes(table(spark, rows)).collect()), key=str) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert orchard.codes(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(1, None, 0), (2, [], 1), (3, [0.1, 0.2, 0.3, 0.4], None), (3, [0.1, 0.2, 0.3, 0.4], None), (4, [0.0, 1e30, 0.0, 0.0], 1), (5, [1.0], 2)]
    assert sorted(map(tuple, orchard.codes(table(spark, few)).collect()), key=str) == brute_codes(few)


def test_orchard_search_is_exact_and_skips():
    c = RNG.integers(-1024, 1024, (40, 16))
    book = orchard.Lists(np.concatenate([c, c[:3], c[5:6] + 1]))  # repeated entries: the first counts
    x = np.concatenate([c[RNG.integers(0, 40, 3000)] + RNG.integers(-90, 90, (3000, 16)), c, [c[0] // 2 + c[1] // 2]])
    at, best, compared = orchard.search(book, x)
    d = ((x[:, None] - book.entries[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    assert compared < 0.9 * d.size
