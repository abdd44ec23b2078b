"""Centroid clustering by dual-tree Lloyd rounds, in exact integers.

Vectors that lie together are dealt to the same tasks and stored once as cover trees, one for each block of vectors. Each round
makes a cover tree over the centroids and walks both trees together: a pair of nodes is pruned when all of its centroids are
farther from all of its vectors than a centroid known to be near, and a node of vectors that is left with one centroid goes to it whole.
Leaf pairs are compared by exact squared distances. A round shuffles one row a task and centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stash, table

#: Vectors of a tree; greatest component, in magnitude, so that squared distances fit 62 bits; pairs whose distances are found at a time.
BLOCK, MOST, AT_ONCE = 2048, 1 << 27, 1 << 14
#: Share by which a bound must be passed before a pair is pruned; roots of whole numbers are exact to 2^-52 of it.
SLACK = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of two tables."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * most * most < 1 << 53:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((x - b) ** 2).sum(1) for x in a]) if len(a) else np.empty((0, len(b)), np.int64)


class Tree:
    """A cover tree: every node is a point, its children are points more than half its reach apart that cover its own, itself first.

    ``point`` and ``radius`` of each node; its children are ``many`` nodes from ``first`` on, its points those from ``lo`` to ``hi`` in the
    order of leaves.
    """

    FIELDS = (("point", np.int32), ("radius", np.float64), ("first", np.int32), ("many", np.int32), ("lo", np.int32), ("hi", np.int32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    def bytes(self) -> list[bytes]:
        return [getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def of(cls, columns: list[bytes]) -> Tree:
        return cls(**{name: np.frombuffer(data, kind) for (name, kind), data in zip(cls.FIELDS, columns)})


def grow(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of distinct points, and their order by leaves, which the tree counts in."""
    far = np.sqrt(squares(points, points))
    nodes: list[list] = [[0, 0.0, 0, 0, 0, len(points)]]
    order, waiting = np.arange(len(points)), [0]
    while waiting:
        node = waiting.pop()
        center, _, _, _, lo, hi = nodes[node]
        own = order[lo:hi].copy()
        reach = far[center, own].max()
        nodes[node][1] = reach
        if hi - lo == 1:
            continue
        nodes[node][2], at = len(nodes), lo
        while len(own):
            near = far[center, own] <= reach / 2
            order[at : at + (n := int(near.sum()))] = own[near]
            nodes.append([center, 0.0, 0, 0, at, at + n])
            at, own = at + n, own[~near]
            center = own[0] if len(own) else -1
        nodes[node][3] = len(nodes) - nodes[node][2]
        waiting += range(nodes[node][2], len(nodes))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    columns = dict(zip((name for name, _ in Tree.FIELDS), map(np.array, zip(*nodes))))
    return Tree(**{**columns, "point": place[columns["point"]]}), order


def distances(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of rows."""
    out = np.empty(len(p), np.int64)
    for k in range(0, len(p), AT_ONCE):
        diff = a[p[k : k + AT_ONCE]] - b[q[k : k + AT_ONCE]]
        out[k : k + AT_ONCE] = np.einsum("ij,ij->i", diff, diff)
    return out


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, ...``, ``many`` of them each."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


class Centroids:
    """A round's centroids and the tree over their distinct values, each known by its smallest number."""

    def __init__(self, centroids: np.ndarray):
        distinct, number = np.unique(centroids, axis=0, return_index=True)
        self.tree, order = grow(distinct)
        self.points, self.number = distinct[order], number[order]


def nearest(tree: Tree, points: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, int]:
    """The number of each point's nearest centroid, of equally near ones the smallest, and how many distances were found."""
    to, out, found = centroids.tree, np.empty(len(points), np.int64), 0
    bound = np.full(len(tree.point), np.inf)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        d2 = distances(points, centroids.points, tree.point[q], to.point[r])
        d, found = np.sqrt(d2), found + len(q)
        np.minimum.at(bound, q, d + tree.radius[q])  # the centre of a node of centroids is one of them
        left = d - tree.radius[q] - to.radius[r] <= bound[q] * (1 + SLACK) + SLACK
        q, r, d2 = q[left], r[left], d2[left]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        many = np.diff(np.append(begin, len(q)))
        node = q[begin]
        widest = np.maximum.reduceat(np.where(to.many[r] > 0, to.radius[r], -1.0), begin)
        # one centroid is left for all points of the node
        sole = (many == 1) & (widest < 0)
        at = spread(tree.lo[node[sole]], tree.hi[node[sole]] - tree.lo[node[sole]])
        out[at] = np.repeat(centroids.number[to.point[r[begin[sole]]]], tree.hi[node[sole]] - tree.lo[node[sole]])
        # leaves against leaves
        leaf = ~sole & (widest < 0) & (tree.many[node] == 0)
        own = np.repeat(leaf, many)
        if own.any():
            a, number = q[own], centroids.number[to.point[r[own]]]
            rank = np.lexsort((number, d2[own], a))
            best = rank[np.flatnonzero(np.diff(a[rank], prepend=-1))]
            out[tree.lo[a[best]]] = number[best]
        # else the wider side is opened
        rest = ~sole & ~leaf
        theirs = rest & (widest >= 0) & ((widest >= tree.radius[node]) | (tree.many[node] == 0))
        open_q, open_r = np.repeat(rest & ~theirs, many), np.repeat(theirs, many)
        kids = tree.many[q[open_q]]
        parents, children, with_r = np.repeat(q[open_q], kids), spread(tree.first[q[open_q]], kids), np.repeat(r[open_q], kids)
        bound[children] = np.minimum(bound[children], bound[parents])
        x, y = q[open_r], r[open_r]
        steps = np.maximum(to.many[y], 1)
        wider = spread(np.where(to.many[y] > 0, to.first[y], y), steps)
        q, r = np.concatenate([children, np.repeat(x, steps)]), np.concatenate([with_r, wider])
        rank = np.argsort(q, kind="stable")
        q, r = q[rank], r[rank]
    return out, found


TREES = ", ".join(f"{name} binary" for name, _ in Tree.FIELDS) + ", points binary, copies binary, ids array<long>"
NAMES = [x.split()[0] for x in TREES.split(", ")]


def rows_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).astype(np.int64).reshape(-1, size)


def _cells(seeds: np.ndarray):
    """The two seeds next to each vector, which put vectors in the order of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squares(rows_of(batch, seeds.shape[1]), seeds)
                first = np.argsort(d, axis=1, kind="stable")[:, :2]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(first[:, 0].astype(np.int32)), pa.array(first[:, -1].astype(np.int32))], names=["vec_id", "v", "a", "b"])

    return run


def _plant(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, block):
                batch = whole.slice(k, block)
                distinct, owner, copies = np.unique(rows_of(batch, size), axis=0, return_inverse=True, return_counts=True)
                tree, order = grow(distinct)
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                ids = batch.column("vec_id").take(pa.array(np.argsort(place[owner], kind="stable"))).to_pylist()
                columns = [*tree.bytes(), distinct[order].astype(np.int32).tobytes(), copies[order].astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in columns), pa.array([ids], pa.list_(pa.int64()))], names=NAMES)

    return run


def planted(batch: pa.RecordBatch, size: int) -> Iterator[tuple[Tree, np.ndarray, np.ndarray, list]]:
    for row in batch.to_pylist():
        points = np.frombuffer(row["points"], np.int32).reshape(-1, size).astype(np.int64)
        yield Tree.of([row[name] for name, _ in Tree.FIELDS]), points, np.frombuffer(row["copies"], np.int32).astype(np.int64), row["ids"]


def _sums(centroids: Centroids, k: int, size: int):
    """Of a task's vectors: count and componentwise sum by centroid, and how many distances were found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, pairs = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for tree, points, copies, _ in planted(batch, size):
                to, found = nearest(tree, points, centroids)
                pairs += found
                order = np.argsort(to, kind="stable")
                begin = np.flatnonzero(np.diff(to[order], prepend=-1))
                own = to[order][begin]
                sums[own] += np.add.reduceat((points * copies[:, None])[order], begin)
                counts[own] += np.add.reduceat(copies[order], begin)
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64())), pa.array(np.where(full == full[0], pairs, 0))], names=["cluster", "n", "s", "pairs"])

    return run


def lloyd_round(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The next centroids, and how many distances were found. One row of numbers a centroid comes to the driver."""
    k, size = centroids.shape
    found = mapped(trees, _sums(Centroids(centroids), k, size), "cluster long, n long, s array<long>, pairs long")
    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    after, pairs = centroids.copy(), 0
    for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.array(*[total(F.col("s")[j]) for j in range(size)]).alias("s")).collect():
        after[r.cluster] = [int(x) // r.n for x in r.s]
        pairs += r.pairs
    return after, pairs


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_of = Centroids(centroids)
        for batch in batches:
            for tree, points, copies, ids in planted(batch, centroids.shape[1]):
                to, _ = nearest(tree, points, tree_of)
                d = distances(points, centroids, np.arange(len(points)), to)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.repeat(to, copies).astype(np.int32)), pa.array(np.repeat(d, copies))], names=["vec_id", "cluster", "distance"])

    return run


def plant(points: DataFrame, seeds: np.ndarray, block: int = BLOCK) -> DataFrame:
    """The stored cover trees of ``vec_id, v``. Vectors are dealt by ranges of place, value and id, so even a vector that very many rows repeat is spread over tasks."""
    size = seeds.shape[1]
    placed = stash(mapped(points, _cells(seeds), "vec_id long, v array<int>, a int, b int").withColumn("h", F.xxhash64("v")), "vectors-placed")
    order = ["a", "b", "h", "vec_id"]
    return stash(mapped(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v"), _plant(size, block), TREES), "vectors-trees")


def quantised(vectors: DataFrame, size: int) -> DataFrame:
    """``vec_id, v``: the vectors that are kept, as whole numbers."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    sound = (F.size("embedding") == size) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) <= MOST / 512), F.lit(False)))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<int>").alias("v"))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2:", block: int = BLOCK, watch: Callable[[int, int], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each kept row of ``vectors`` (vec_id, embedding), stored, and the final centroids.

    Kept are vectors of exactly ``size`` components, none of them null, non-finite or over 2^18 in magnitude, beyond which squared distances pass 64 bits. The
    first centroids are the ``k`` vectors whose ids, behind ``seed``, have the least hashes, equal hashes by value; a vector without an id is clustered, but
    begins a centroid only where ids are too few. Repeated rows count each; equal vectors share a cluster. Equally near centroids go by number; one without vectors stays.
    Fewer vectors than ``k`` make fewer centroids; no vectors give no rows and no centroids. ``k`` is bounded by the driver, which holds the centroids and, for their tree, k x k distances.
    ``watch`` is told how many distances each round found.
    """
    points = quantised(vectors, size)
    first = points.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, size)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    trees = plant(points, centroids, block)
    for r in range(rounds):
        centroids, pairs = lloyd_round(trees, centroids)
        if watch:
            watch(r, pairs)
    return stash(mapped(trees, _assign(centroids), "vec_id long, cluster int, distance long"), "clusters"), centroids


def op13_dual_tree(spark, sf_dir):
    found, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # one row a centroid
    own = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    return found.join(spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(r: int) -> str:
    """The centroids after round ``r``, from the vectors as that round assigns them."""
    return rf"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT vec_id, k.v, c, (nv + nc - 2 * list_dot_product(x, y))::BIGINT AS d FROM k, c{r}) GROUP BY vec_id, v),
m{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, v, v::DOUBLE[] AS y, list_dot_product(v::DOUBLE[], v::DOUBLE[]) AS nc FROM (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c)))"""


#: The same rows by comparing every vector with every centroid, for components that doubles square exactly.
OP13_SQL = rf"""
WITH k AS MATERIALIZED (SELECT vec_id, v, v::DOUBLE[] AS x, list_dot_product(v::DOUBLE[], v::DOUBLE[]) AS nv FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v, x AS y, nv AS nc FROM k QUALIFY c < 40),
{', '.join(_round(r) for r in range(6))}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (c)
"""
