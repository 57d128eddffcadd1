"""Embedding near-duplicates: exact links above a cosine, by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most t = sqrt(2 - 2c). Copies are one node with a
multiplicity. A nested net of a bounded sample gives at most MOST_CELLS centres; every node of a large group of equal
labels goes to the cell of its nearest centre, whose covering radius is then measured over all nodes, and cells are cut
into blocks of about PART nodes. A node meets another cell's blocks only if the covering ball and the half-space of
that cell lie within t of it. Inside a task two blocks meet as two cover trees, whose levels halve the radius: pairs of
tree nodes whose balls are further than t apart are dropped, those that lie wholly within t are linked whole, and
the rest descends to exact products. A pair of blocks gives a row a linked node (its number of links and its root
among the two blocks), never a row a link, so a group of near copies of any size stays linear in what is shuffled.

Cases. Vectors that are null, empty, zero or hold null or non-finite components, and all of a null label, link with
nothing and are their own component. Vectors of different lengths don't link. Each row is a vector, also if it repeats
another or its id; null ids don't count as the smallest, and a component with no other has a null component_id and keeps
none. An empty table gives an empty result. Further columns don't matter. Very long vectors make the sample smaller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.llm.components import components
from kgcube.llm.store import stored
from kgcube.llm.vectors import doubles, finite, lists, looked_up, matrix
from kgcube.sources.tables import MOST_BROADCAST_ROWS, small

COSINE = 0.98
#: Nodes of a block; a group of at most so many is one block.
PART = 1024
#: Centres of the upper levels, and bytes of the sample that they come from.
MOST_CELLS, SAMPLE_BYTES = 1024, 4 << 20
#: Nodes of a tree's leaf, centres of one split, and nodes that make a centre's ball worth a child.
LEAF, FAN, LEAST = 32, 64, 4
#: Bounds err on the safe side by this.
SLACK = 1e-7
#: Cosines nearer than this to the threshold are computed anew, term by term, so that blocks can't matter.
CLOSE = 1e-12


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; the directions are the same bits."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the centres of nested nets: at radii 1, 1/2, 1/4, ... the first point that no centre covers is one."""
    centres, near, radius = [0], apart(points, points[:1])[:, 0], 1.0
    while len(centres) < most and near.max() > 1e-6:
        free = np.flatnonzero(near > radius)
        if not len(free):
            radius /= 2
            continue
        centres.append(int(free[0]))
        near = np.minimum(near, apart(points, points[free[:1]])[:, 0])
    return np.array(centres)


class Node:
    """A ball of points: a point as centre with its covering radius, the mean with its own, and children or none."""

    def __init__(self, points: np.ndarray, index: np.ndarray, centre: int):
        own = points[index]
        self.index, self.at, self.centre, self.near = index, centre, points[centre], np.sqrt(((own - points[centre]) ** 2).sum(1))
        self.radius, self.mean, self.children = float(self.near.max()), own.mean(0), []
        self.spread = float(np.sqrt(((own - self.mean) ** 2).sum(1).max()))


def tree(points: np.ndarray) -> Node:
    """A node's children cover it with balls of half its radius; what only lies in balls of few points stays
    together in one child around the node's own centre."""
    root = Node(points, np.arange(len(points)), 0)
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.index) <= LEAF or node.radius <= SLACK:
            continue
        half, near, owner, own = node.radius / 2, node.near.copy(), np.zeros(len(node.index), np.int64), points[node.index]
        owner[near > half] = -1
        centres = [node.at]
        while len(centres) < FAN and len(free := np.flatnonzero(owner < 0)):
            d = np.sqrt(((own - own[free[0]]) ** 2).sum(1))
            owner[(owner < 0) & (d <= half)] = len(centres)
            centres.append(int(node.index[free[0]]))
        sizes = np.bincount(owner[owner >= 0], minlength=len(centres))
        kept = [k for k in range(len(centres)) if sizes[k] >= LEAST]
        if not kept:
            continue
        rest = node.index[~np.isin(owner, kept)]
        node.children = [Node(points, node.index[owner == k], centres[k]) for k in kept]
        open_ += node.children
        if len(rest):
            node.children.append(Node(points, rest, int(rest[0])))
    return root


def dual(a: Node, b: Node, t: float) -> tuple[np.ndarray, np.ndarray, list[tuple[Node, Node]]]:
    """Of two trees (or of one with itself, then each pair once): pairs of indexes that surely are within t, and pairs of
    leaves that must be compared."""
    sure, leaves, todo = [], [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if np.sqrt(((x.centre - y.centre) ** 2).sum()) > x.radius + y.radius + t + SLACK:
            continue
        if np.sqrt(((x.mean - y.mean) ** 2).sum()) + x.spread + y.spread <= t - SLACK:
            i, j = np.triu_indices(len(x.index), 1) if x is y else np.divmod(np.arange(len(x.index) * len(y.index)), len(y.index))
            sure.append((x.index[i], y.index[j]))
        elif not x.children and not y.children:
            leaves.append((x, y))
        elif x is y:
            todo += [(p, q) for n, p in enumerate(x.children) for q in x.children[n:]]
        elif y.children and (not x.children or y.radius > x.radius):
            todo += [(x, q) for q in y.children]
        else:
            todo += [(p, y) for p in x.children]
    i, j = (np.concatenate([s[k] for s in sure]) if sure else np.zeros(0, np.int64) for k in (0, 1))
    return i, j, leaves


def within(a: np.ndarray, b: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of linked rows of a and b, or, each pair once, of a alone."""
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    ua, own = units(a), b is None
    ub, b = (ua, a) if own else (units(b), b)
    ta = tree(ua)
    i, j, leaves = dual(ta, ta if own else tree(ub), t)
    found = [(i, j)]
    for x, y in leaves:
        cos = ua[x.index] @ ub[y.index].T
        if x is y:
            cos[np.tril_indices(len(cos))] = -2
        for p, q in np.argwhere(np.abs(cos - cosine) < CLOSE):
            u, v = a[x.index[p]], b[y.index[q]]
            cos[p, q] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))
        p, q = np.nonzero(cos >= cosine)
        found.append((x.index[p], y.index[q]))
    return tuple(np.concatenate(s) for s in zip(*found, strict=True))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n points the smallest that links lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def linked(nodes: DataFrame, cosine: float = COSINE, part: int = PART) -> DataFrame:
    """nodes(node long, grp string, n long, vec array<double>), a stored table whose vectors have one length within a
    group -> (node, root, n): for each pair of blocks in which the node has links, the sum of n over what it is linked
    with there, and the smallest node that these links lead to."""
    spark = nodes.sparkSession
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    groups = stored(nodes.groupBy("grp").agg(F.count("*").alias("size"), F.max(F.size("vec")).alias("dims")))
    top = groups.agg(F.max("size"), F.max("dims"), F.count("*")).first()
    cells = min(MOST_CELLS, -(-(top[0] or 0) // part))
    centres: dict[int, np.ndarray] = {}
    sized = looked_up(nodes, groups.select("grp", "size"), ["grp"], top[2])
    if cells > 1:
        rows = max(1, SAMPLE_BYTES // (8 * top[1]))
        sample = sized.where(F.col("size") > part).orderBy(F.xxhash64("node"), "node").limit(rows).select("vec").collect()
        by: dict[int, list] = {}
        for (v,) in sample:
            by.setdefault(len(v), []).append(v)
        for dims, vs in by.items():
            u = units(scaled(np.array(vs)))
            centres[dims] = u[net(u, cells)]
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, size = batch.column("vec").value_lengths().to_numpy(), batch.column("size").to_numpy()
            cell, near = np.zeros(len(size), np.int32), np.full(len(size), 2.0)
            for dims in np.unique(length):
                at = np.flatnonzero((length == dims) & (size > part))
                if len(at) and dims in shared.value:
                    d = apart(units(scaled(matrix(batch.column("vec").take(pa.array(at))))), shared.value[dims])
                    cell[at], near[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "grp", "n", "vec")] + [pa.array(cell), pa.array(near)], names=["node", "grp", "n", "vec", "cell", "near"])

    placed = stored(sized.mapInArrow(assign, "node long, grp string, n long, vec array<double>, cell int, near double"))
    balls = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"), F.max("near").alias("radius"))
    balls = stored(balls.groupBy("grp").agg(F.collect_list(F.struct("cell", "parts", "radius")).alias("balls")))  # at most MOST_CELLS of a group
    entries = balls.agg(F.coalesce(F.sum(F.size("balls")), F.lit(0))).first()[0]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node once for every pair of blocks that it is needed in."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node, cell = batch.column("node").to_numpy(), batch.column("cell").to_numpy()
            _, first, group = np.unique(batch.column("grp").to_numpy(zero_copy_only=False).astype(str), return_index=True, return_inverse=True)
            for g, start in enumerate(first):
                ball = batch.column("balls")[int(start)].as_py()
                ids, parts, radius = (np.array([x[k] for x in ball]) for k in ("cell", "parts", "radius"))
                for at in np.array_split(np.flatnonzero(group == g), max(1, (group == g).sum() * len(ids) >> 14)):
                    vectors = scaled(matrix(batch.column("vec").take(pa.array(at))))
                    own = np.searchsorted(order := np.sort(ids), cell[at])
                    own = np.argsort(ids)[own]
                    reach = ids[None, :] == ids[own][:, None]
                    if len(ids) > 1:
                        c = shared.value[vectors.shape[1]][ids]
                        d = apart(units(vectors), c)
                        between = np.maximum(apart(c, c)[own], 1e-9)
                        beyond = (d**2 - d[np.arange(len(at)), own][:, None] ** 2) / (2 * between)  # to the half-space of the other cell
                        reach |= (beyond <= t + SLACK) & (d <= radius[None, :] + t + SLACK)
                    r, k = np.nonzero(reach)
                    home = ids[own].astype(np.int64) << 32 | (node[at] ^ node[at] >> 33) * 0x9E3779B1 % (1 << 31) % parts[own]
                    times = parts[k]
                    r, k = np.repeat(r, times), np.repeat(k, times)
                    other = ids[k].astype(np.int64) << 32 | np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
                    for cut in np.array_split(np.arange(len(r)), max(1, len(r) >> 14)):
                        i = r[cut]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("grp").take(pa.array(at[i])), pa.array(np.minimum(home[i], other[cut])), pa.array(np.maximum(home[i], other[cut])), pa.array(home[i]), batch.column("node").take(pa.array(at[i])), batch.column("n").take(pa.array(at[i])), lists(vectors[i])],
                            names=["grp", "a", "b", "home", "node", "n", "vec"],
                        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, ["grp", "a", "b"]):
            home, node, n, v = table.column("home").to_numpy(), table.column("node").to_numpy(), table.column("n").to_numpy(), matrix(table.column("vec").combine_chunks())
            a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
            if a == b:
                i, j = within(v, None, cosine)
            else:
                left, right = np.flatnonzero(home == a), np.flatnonzero(home == b)
                if not len(left) or not len(right):
                    continue
                i, j = within(v[left], v[right], cosine)
                i, j = left[i], right[j]
            if not len(i):
                continue
            total = np.zeros(len(node), np.int64)
            np.add.at(total, i, n[j])
            np.add.at(total, j, n[i])
            by_node = np.argsort(node)
            place = np.empty_like(by_node)
            place[by_node] = np.arange(len(node))
            least = node[by_node][roots(len(node), place[i], place[j])][place]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(least[at]), pa.array(total[at])], names=["node", "root", "n"])

    met = looked_up(placed, balls, ["grp"], entries).mapInArrow(meet, "grp string, a long, b long, home long, node long, n long, vec array<double>")
    return met.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b").mapInArrow(compare, "node long, root long, n long")


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for start, end in zip([0, *new], [*new, batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of embeddings(vec_id, embedding, label)."""
    vec = doubles("embedding")
    usable = F.col("label").isNotNull() & finite(vec) & F.exists(vec, lambda x: x != 0)
    grp = F.concat_ws(":", F.size("embedding"), F.col("label").cast("string"))
    rows = embeddings.select("vec_id", F.when(usable, grp).alias("grp"), F.when(usable, vec).alias("vec"))
    rows = rows.withColumns({"k1": F.xxhash64("grp", "vec"), "k2": F.xxhash64(F.lit(7), "vec", "grp")})  # copies: 128 bits alike
    nodes = rows.where("grp is not null").groupBy("grp", "k1", "k2").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = stored(linked(nodes.select("node", "grp", "n", "vec"), cosine, part))
    total = found.groupBy("node").agg(F.sum("n").alias("others"))
    of = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = stored(nodes.join(of, "node").select("node", "root", "least"))
    least = members.groupBy("root").agg(F.min("least").alias("smallest"))
    classes = members.join(small(least), "root").select("node", "smallest")
    done = nodes.join(total, "node", "left").join(classes, "node", "left")
    done = stored(done.select("k1", "k2", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component")))
    # a node of many copies is a hot key: these few are broadcast, and no other has many rows
    count = done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(10_000, count // MOST_BROADCAST_ROWS)
    keys = rows.where("grp is not null").drop("vec", "grp")
    common = keys.join(F.broadcast(done.where(hot).drop("n")), ["k1", "k2"])  # at most MOST_BROADCAST_ROWS rows
    other = keys.join(F.broadcast(done.where(hot).select("k1", "k2")), ["k1", "k2"], "left_anti").join(done.where(~hot).drop("n"), ["k1", "k2"])
    alone = rows.where("grp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    compared = common.unionByName(other).select("vec_id", "n_links", F.col("component").alias("component_id"))
    return compared.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM (SELECT * FROM v WHERE usable) a JOIN (SELECT * FROM v WHERE usable) b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
),
reach AS (SELECT a AS n, a AS m FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) ON a = vec_id LEFT JOIN (SELECT n, min(m) AS c FROM reach GROUP BY n) ON n = vec_id
"""
