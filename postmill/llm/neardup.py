"""Near-duplicates by similarity of word shingles: SimHash with pivot distance tables, then an exact set join with prefix, length and position filters.

SimHash fingerprints meet through the pivot tables of ``simhash``. Texts that link there at two bits are verified by the similarity itself, and those that have it are one
component from then on. Fingerprints of texts just over the similarity differ in more bits, so the set join finds the links between what is left.

Shingles are ordered by how many texts hold them, the rarest first. Two sets of the similarity asked for share a shingle in the first
part of both, and at their first common one enough of both is left; so only texts that meet there are compared, and no pair is lost. Counts
need not be exact for that, only one order for all: they are kept in files of the shingles that occur more than once. The others take
places in the order but are no keys.

Only components are wanted, so pairs within one are not made. First, in a few rounds, each text is compared with the likeliest of its keys' leaders, which
leaves one component of a crowd of copies; keys that hold one component only are dropped; then all pairs that are left between components
are made, and verified in rounds, likeliest first, until none is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Held, mapped, new_dir, put_file, release, remove, slices, stash, texts
from .components import components
from .simhash import links, shingles, with_fingerprint

#: Text bytes for each file of repeated shingles; rounds in which texts meet leaders; pairs of a text that the first round of the rest verifies.
PART_BYTES, STARS, NEAREST = 8 << 20, 3, 4
_TINY = 1e-9


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    for text in texts(batch, "text"):
        words = text.translate(LOWER).split()
        yield b" ".join(words), np.unique(np.fromiter(map(digest, shingles(words, n)), np.uint64))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [xxhash.xxh3_128_digest(b" ".join(t.translate(LOWER).split())) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "digest"])


def _cut(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The file of each shingle and the 32 bits that tell it there."""
    return (tokens >> np.uint64(64 - bits)).astype(np.int64), (tokens >> np.uint64(32 - bits)).astype(np.uint32)


def _counts(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, many = np.unique(np.concatenate([s for _, s in _sets(batch, n)]), return_counts=True)
            part, rest = _cut(tokens, bits)
            many = np.minimum(many, 65535).astype(np.uint16)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*at[1:].tolist(), len(part)]
            spans = list(zip(at.tolist(), ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at]), pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([many[a:b].tobytes() for a, b in spans], pa.binary())], names=["part", "rest", "many"]
            )

    return run


def _merged(uri: str):
    def run(table: pa.Table) -> pa.Table:
        rest = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("rest").to_pylist()])
        many = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("many").to_pylist()])
        order = np.argsort(rest, kind="stable")
        rest = rest[order]
        first = np.flatnonzero(np.diff(rest, prepend=rest[:1] ^ np.uint32(1)))
        sums = np.add.reduceat(many[order].astype(np.int64), first)
        keep = sums > 1
        part = table.column("part")[0].as_py()
        put_file(f"{uri}/{part}", rest[first][keep].tobytes(), np.minimum(sums[keep], 65535).astype(np.uint16).tobytes())
        return pa.table({"part": pa.array([part], pa.int64())})

    return run


def _known(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    many = len(data) // 6
    return np.frombuffer(data, np.uint32, many), np.frombuffer(data, np.uint16, many, 4 * many)


def _keys(n: int, similarity: float, uri: str, bits: int):
    """Of each text that has any: the keys among its first shingles, their places in its order, and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Held()
        for batch in slices(batches, "text"):
            same, sets = zip(*_sets(batch, n))
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            part, rest = _cut(flat[order], bits)
            found = np.ones(len(flat), np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
                keys, many = files.get(f"{uri}/{part[a]}", _known)
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, rest[a:b]), len(keys) - 1)
                    found[order[a:b]] = np.where(keys[where] == rest[a:b], many[where], 1)
            rows, start = [], 0
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), same, sets):
                many, start = found[start : start + len(own)], start + len(own)
                first = np.argsort(many, kind="stable")[: len(own) - math.ceil(similarity * len(own) - _TINY) + 1]
                places = np.flatnonzero(many[first] > 1)
                if len(places):
                    rows.append((doc_id, xxhash.xxh3_128_digest(text), len(own), own[first[places]].view(np.int64), places, own.tobytes()))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], names=["node", "digest", "size", "keys", "places", "set"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(b, np.uint64) for b in batch.column(c).to_pylist()] for c in ("x", "y"))
            keep = []
            for a, b in zip(x, y):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - _TINY)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def between(index: DataFrame, roots: DataFrame) -> DataFrame:
    """``index`` with the root of each node, without the keys that hold one component only."""
    named = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    return named.join(several, "key", "left_semi")


def _pair(u: str, v: str) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def led(named: DataFrame, turn: int) -> DataFrame:
    """``u, v``: each node and the leader of most of its keys, of another component; first those of most keys lead, then others by hash."""
    rank = F.count("*").over(Window.partitionBy("node")) if turn == 0 else F.xxhash64("node", F.lit(turn))
    leaders = named.withColumn("rank", rank).groupBy("key").agg(F.max(F.struct("rank", "node", "root")).alias("its"))
    pairs = named.join(leaders, "key").where("root <> its.root").groupBy("node", F.col("its.node").alias("leader")).agg(F.count("*").alias("shared"))
    likeliest = F.max_by("leader", F.struct("shared", F.negative("leader"))).alias("leader")
    return pairs.groupBy("node").agg(likeliest).select(*_pair("node", "leader")).distinct()


def crossing(named: DataFrame, similarity: float) -> DataFrame:
    """``u, v, shared``: all pairs of different components that may have the similarity."""
    x, y = named.alias("x"), named.alias("y")
    least = F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - _TINY
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.struct("x.size", "x.node") < F.struct("y.size", "y.node"))
    meet = meet & (F.col("x.size") >= F.lit(similarity) * F.col("y.size") - _TINY)
    meet = meet & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= least)
    return x.join(y, meet).select(*_pair("x.node", "y.node")).groupBy("u", "v").agg(F.count("*").alias("shared"))


def pivot_pairs(docs: DataFrame, nodes: DataFrame, shingle: int, home: str) -> DataFrame:
    """``u, v``: texts (``node``: the document that stands for each) of linked SimHash fingerprints, each fingerprint by its least document, and that with the others of its fingerprint."""
    # texts stay where they are: fingerprints are joined, not what they are made of
    prints = with_fingerprint(docs, shingle, ["doc_id"]).join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    prints = stash(prints, "prints", home)
    firsts = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "firsts", home)
    same = prints.join(firsts, "fp").where("doc_id <> node").select(*_pair("doc_id", "node"))
    x, y = (firsts.select(F.col("fp").alias(fp), F.col("node").alias(node)) for fp, node in (("u", "a"), ("v", "b")))
    near = links(firsts.select("fp")).join(x, "u").join(y, "v").where("a <> b").select(*_pair("a", "b"))
    return same.unionByName(near).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, text`` to ``doc_id, component_id``: the least id of the documents that are linked by a similarity of ``similarity`` or more.

    Equal word sequences are linked whatever their length, empty ones too. Rows of a null id are left out. Rows that repeat an id with
    different texts link all that either links. An empty table gives an empty result.
    """
    spark, home = docs.sparkSession, new_dir(docs.sparkSession, "near-duplicates")
    keep = lambda df, name: stash(df, name, home)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    prints = keep(mapped(docs, _digests, "doc_id long, digest binary"), "digests")
    texts_of = keep(prints.groupBy("digest").agg(F.min("doc_id").alias("node")), "texts")
    edges = keep(prints.join(texts_of, "digest").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v"), "copies")

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, uri = max(1, math.ceil(math.log2(max(total / PART_BYTES, 1)))), f"{home}/repeated"
    counted = mapped(docs, _counts(shingle, bits), "part long, rest binary, many binary")
    counted.groupBy("part").applyInArrow(_merged(uri), "part long").count()
    release(spark)
    schema = "node long, digest binary, size long, keys array<long>, places array<long>, set binary"
    every = new_dir(spark, "sets")
    sets = stash(mapped(docs, _keys(shingle, similarity, uri, bits), schema), "sets", every)
    own = sets.drop("set").join(texts_of, ["node", "digest"], "left_semi")
    rows = own.select("node", "size", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "node", "size", F.col("k.places").alias("place"))
    repeated = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    index = keep(rows.join(repeated, "key", "left_semi"), "index")
    release(spark)

    def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        involved = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        few = sets.select("node", "set").join(involved, "node", "left_semi")
        x, y = (few.select(F.col("node").alias(c), F.col("set").alias(s)) for c, s in (("u", "x"), ("v", "y")))
        return mapped(pairs.select("u", "v").join(x, "u").join(y, "v").select("u", "v", "x", "y"), _similar(similarity), "u long, v long")

    done = keep(pivot_pairs(docs, texts_of, shingle, home), "pivoted")
    edges = keep(edges.unionByName(similar(done, sets)), "near")
    release(spark)
    for turn in range(STARS):
        named = keep(between(index, components(edges)), "between")
        if not turn:  # components only grow, so no text outside these is compared any more; the few sets left are what later rounds shuffle
            open_sets = keep(sets.select("node", "set").join(named.select("node").distinct(), "node", "left_semi"), "open-sets")
            remove(spark, every)
            release(spark)
        pairs = keep(led(named, turn), "led")
        done = done.unionByName(pairs)
        edges = keep(edges.unionByName(similar(pairs, open_sets)), "near")
        release(spark)
    named = keep(between(index, components(edges)), "between")
    todo = keep(crossing(named, similarity).join(done.distinct(), ["u", "v"], "left_anti"), "candidates")
    release(spark)
    nearest = NEAREST
    while True:
        roots = components(edges)
        named = todo
        for c in ("u", "v"):
            named = named.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
        # a pair's turn at either of its ends decides
        left = named.where("u_root <> v_root").select("u", "v", "shared")
        turn = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.col("shared").desc(), "u", "v"))
        left = keep(left.withColumn("turn", F.least(turn("u"), turn("v"))), "unverified")
        if not left.limit(1).count():
            break
        edges = keep(edges.unionByName(similar(left.where(F.col("turn") <= nearest), open_sets)), "near")
        todo = left.where(F.col("turn") > nearest).select("u", "v", "shared")
        nearest *= 4
        release(spark)
    found = prints.select("doc_id").distinct().join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
    found = stash(found, "components")
    remove(spark, home)
    return found


def brute_force(docs: list[tuple[int, str | None]], shingle: int = 5, similarity: float = 0.8) -> dict[int, int]:
    """The components of small inputs with distinct ids."""
    own = [(t or "").encode().translate(LOWER).split() for _, t in docs]
    sets = [set(shingles(w, shingle)) for w in own]
    label = {d: d for d, _ in docs}
    pairs = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if own[i] == own[j] or len(sets[i] & sets[j]) >= max(1, similarity * len(sets[i] | sets[j]) - _TINY)]
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            least = min(label[u], label[v])
            changed = changed or label[u] != label[v]
            label[u] = label[v] = least
    return label
