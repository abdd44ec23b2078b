"""Connected components of an undirected graph by alternating large and small stars.

Every step is a grouped minimum, which combines before the shuffle, and a join, which Spark may split where a node
has very many neighbours. Each round is stored in the shared folder, so a lost executor costs a round at most. What is
left, once it is few edges by count, is joined in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stash

#: Edges that one task finishes, with 60 MB of its memory at most, to save rounds. More are contracted by stars, which leave fewer, until they fit or are stars; the result is the same.
ONE_TASK = 1 << 17


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = up = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in root]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, r in found if x != r], pa.int64()), pa.array([r for x, r in found if x != r], pa.int64())], names=["node", "root"])


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Joins each node's neighbours to the least of them: the larger ones (both ways) or the smaller ones and the node."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(least, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` of a 64-bit type to ``node, root``: the least node of its component, for each node of an edge that isn't one itself."""
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stash(edges.where("u <> v").select(larger, smaller).distinct(), "edges")
    seen = _print_of(now)
    while seen[0]:
        if seen[0] <= ONE_TASK:
            return stash(mapped(now.coalesce(1), _joined, "node long, root long"), "roots")
        now = stash(_stars(_stars(now, True), False), "edges")
        before, seen = seen, _print_of(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
