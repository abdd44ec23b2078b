"""SimHash near-dedup with pivot distance tables.

Fingerprints of 64 bits link at few differing bits. The table holds each fingerprint's Hamming distances to many
reference fingerprints; it is made once for each distinct fingerprint and stored. Some references come in pairs that agree on one block of bits and are opposite
elsewhere, so the sum of the two distances tells the distance on that block alone: a block's coordinates. Of ``distance + 2`` blocks,
two at least are the same in a linked pair, so pairs are joined on the coordinates of two blocks and lose none.
A pair is discarded if any coordinate in the whole table differs by more than the distance, by the
triangle inequality; the survivors are verified on their bits. Where very many fingerprints share two blocks, the
same is done once more on finer blocks of the bits that are left, down to groups that bits bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, mapped, slices, stash, texts
from .components import components

#: Reference patterns a block, and fingerprints that share a key before it is refined.
PATTERNS, CROWD = 8, 256


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Runs of ``n`` words joined by a space; fewer words: the whole sequence."""
    if 0 < len(words) < n:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(words[k:] for k in range(n))))


def fingerprints(batch: pa.RecordBatch, n: int) -> np.ndarray:
    digest, hashes, sizes = partial(xxhash.xxh64_intdigest, seed=42), [], []
    for text in texts(batch, "text"):
        before = len(hashes)
        hashes.extend(map(digest, shingles(text.translate(LOWER).split(), n)))
        sizes.append(len(hashes) - before)
    sizes, out = np.array(sizes), np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > sizes[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array(fingerprints(batch, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, "fp"])

    need = docs.select(*dict.fromkeys([*keep, "text"]))
    return mapped(need, run, T.StructType([*(need.schema[c] for c in keep), T.StructField("fp", T.LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _far(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference))))


def references(blocks: list[int], seed: int) -> list[list[tuple[int, int]]]:
    """For each block, pairs of reference fingerprints: random on the block, all 0 or all 1 elsewhere."""
    rng, full = np.random.default_rng(seed), (1 << 64) - 1
    out = []
    for block in blocks:
        patterns = [int(x) & block for x in rng.integers(0, 1 << 63, PATTERNS, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, PATTERNS, dtype=np.uint64)]
        out.append([(p, p | (full & ~block)) for p in patterns])
    return out


def split(bits: int, parts: int) -> list[int]:
    """Cuts the set bits of a mask into ``parts`` masks of nearly equal size."""
    own = [k for k in range(64) if bits >> k & 1]
    return [sum(1 << k for k in own[len(own) * p // parts : len(own) * (p + 1) // parts]) for p in range(parts)]


def _coordinates(fp: Column, pairs: list[tuple[int, int]], block: int) -> list[Column]:
    """Distances on a block alone, from the distances to both references of each pair."""
    outside = 64 - block.bit_count()
    return [((_far(fp, p) + _far(fp, q) - outside) / 2).cast("byte") for p, q in pairs]


def _located(nodes: DataFrame, free: int, distance: int, level: int) -> DataFrame:
    """Adds the coordinates of each block of the ``free`` bits."""
    blocks = split(free, distance + 2)
    parts = [F.array(*_coordinates(F.col("fp"), pairs, block)).alias(f"part{k}") for k, (pairs, block) in enumerate(zip(references(blocks, level + 1), blocks))]
    return nodes.select("key", "fp", "near", "wide", *parts)


def _keyed(located: DataFrame, free: int, distance: int, level: int) -> tuple[DataFrame, list[int]]:
    """``key, fp, near, wide, turn`` for each two blocks' coordinates, and the bits then left free, by turn."""
    blocks = split(free, distance + 2)
    twos = [(a, b) for a in range(len(blocks)) for b in range(a)]
    keys = [F.xxhash64("key", F.lit(level * 64 + a * 8 + b), f"part{a}", f"part{b}") for a, b in twos]
    rows = located.select("fp", "near", "wide", F.posexplode(F.array(*keys)).alias("turn", "key"))
    return rows, [free & ~(blocks[a] | blocks[b]) for a, b in twos]


def _table(fp: Column) -> list[Column]:
    """A packed row of the pivot table: 16 distances, a byte each."""
    rng = np.random.default_rng(7)
    far = [_far(fp, int(x)) for x in rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2)]
    pack = lambda part: sum((d.cast("long") * F.lit(1 << 7 * k) for k, d in enumerate(part)), F.lit(0).cast("long"))
    return [pack(far[:8]).alias("near"), pack(far[8:]).alias("wide")]


def _within(x: str, y: str, distance: int) -> Column:
    """No coordinate of two packed rows differs by more than ``distance``."""
    part = lambda c, k: F.shiftright(F.col(c), 7 * k).bitwiseAND(F.lit(127))
    tests = [F.abs(part(f"{x}.{c}", k) - part(f"{y}.{c}", k)) <= distance for c in ("near", "wide") for k in range(8)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def meeting(keyed: DataFrame) -> DataFrame:
    """Pairs of rows that share a key, each with both rows of the pivot table."""
    return keyed.alias("x").join(keyed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))


def _pairs(keyed: DataFrame, distance: int) -> DataFrame:
    """Pairs that the table leaves, verified on their bits."""
    left = meeting(keyed).where(_within("x", "y", distance)).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    return left.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def pivots(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """The table of distances, once for each ``fp``: 16 to references of any bits, and the coordinates of each block."""
    rows = nodes.select(F.lit(0).cast("long").alias("key"), "fp", *_table(F.col("fp")))
    return stash(_located(rows, (1 << 64) - 1, distance, 0), "pivots")


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct ``fp`` to all pairs ``u, v`` at ``distance`` bits or fewer."""
    found, todo = [], [(pivots(nodes, distance), (1 << 64) - 1)]
    level = 0
    while todo:
        every, frees = None, []
        for located, bits in todo:
            part, left = _keyed(located, bits, distance, level)
            part = part.select("key", "fp", "near", "wide", (F.col("turn") + len(frees)).alias("free"))
            every, frees = part if every is None else every.unionByName(part), frees + left
        every = stash(every, "pivot-keys")
        many = every.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        last = all(free.bit_count() <= 8 for free in frees)  # then bits bound a group
        few = many if last else many.where(F.col("many") <= CROWD)
        found.append(stash(_pairs(every.join(few, "key", "left_semi"), distance), "links"))
        if last:
            break
        crowded = stash(every.join(many.where(F.col("many") > CROWD), "key", "left_semi"), "crowds")
        alive = {r.free for r in crowded.select("free").distinct().collect()}
        level += 1
        todo = [(_located(crowded.where(F.col("free") == k), frees[k], distance, level), frees[k]) for k in sorted(alive)]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, text`` to ``doc_id, fingerprint, component_id`` for every row.

    Null and wordless texts have fingerprint zero, linked like any other; rows that repeat an id are kept; a null id
    is no component's name unless no member has another; an empty table gives an empty result.
    """
    prints = stash(with_fingerprint(docs, shingle, ["doc_id"]), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, distance)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(rooted.join(names, "root").select(F.col("fp").alias("node"), "component_id"), "named")
    return prints.join(named, F.col("fp") == F.col("node")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir):
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(docs: list[tuple[int, str | None]], shingle: int = 3, distance: int = 2) -> list[tuple]:
    """The rows of op1 for small inputs."""
    prints = []
    for _, text in docs:
        votes, many = [0] * 64, 0
        for s in shingles((text or "").encode().translate(LOWER).split(), shingle):
            h, many = xxhash.xxh64_intdigest(s, seed=42), many + 1
            votes = [v + (h >> k & 1) for k, v in enumerate(votes)]
        prints.append(sum(1 << k for k, v in enumerate(votes) if 2 * v > many))
    label = [d for d, _ in docs]
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return [(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, label)]
