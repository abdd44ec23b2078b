"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

Lines are paragraphs, runs of them between blank lines are sections, and a paragraph is cut into pieces, the leaves, where its own bytes say so,
so that an insertion changes the leaf that it is in and no other. A node's digest is over its children's. A fingerprint holds the tree: the root's digest, then of each
node above the leaves, in order, how many children it has and its digest, and of each leaf its digest. Equal roots mean equal texts; going down only into branches whose digests
differ finds what was edited and how alike two texts are, from their fingerprints alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, slices, stash, texts

#: Bytes of the root's digest, of other nodes' and of leaves', and the least bytes of a leaf that others of its paragraph follow.
ROOT, INNER, LEAF, LEAST = 16, 8, 4, 32
_digest, _root = xxhash.xxh3_64_digest, xxhash.xxh3_128_digest
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The leaf of a blank line, which has no weight.
BLANK = bytes(LEAF)

#: A leaf is its digest; any other node is its digest and its children. The root has sections, these have paragraphs, these have leaves or are one.
Node = bytes | tuple[bytes, list]


def cuts(text: bytes) -> list[int]:
    """Where leaves may end: after one of 64 runs of 8 bytes, by a hash of the run."""
    many = len(text)
    if many < 8 + LEAST:
        return []
    found = np.empty(many - 7, bool)
    for k in range(8):
        found[k::8] = np.frombuffer(text, "<u8", (many - k) // 8, k) * _SPREAD >> np.uint64(58) == 0
    return (np.flatnonzero(found) + 8).tolist()


def _inner(digests: list[bytes], children: list[Node]) -> tuple[bytes, tuple[bytes, list]]:
    full = _digest(b"".join(digests))
    return full, (full[:INNER], children)


def tree(text: bytes) -> tuple[bytes, list]:
    """The root; a blank line is a paragraph that ends its section."""
    points, at, start = cuts(text), 0, 0
    sections, full, paragraphs, own = [], [], [], []

    def close() -> None:
        digest, node = _inner(own, paragraphs.copy())
        full.append(digest)
        sections.append(node)
        paragraphs.clear()
        own.clear()

    for line in text.split(b"\n"):
        end, last, leaves = start + len(line), start, []
        while at < len(points) and points[at] < end:
            if points[at] - last >= LEAST:
                leaves.append(_digest(text[last : points[at]]))
                last = points[at]
            at += 1
        leaves.append(_digest(text[last:end]))
        start, blank = end + 1, not line.strip()
        if len(leaves) == 1:
            own.append(leaves[0])
            paragraphs.append(BLANK if blank else leaves[0][:LEAF])
        else:
            digest, node = _inner(leaves, [x[:LEAF] for x in leaves])
            own.append(digest)
            paragraphs.append(node)
        if blank:
            close()
    if own:
        close()
    return _root(b"".join(full)), sections


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def encode(root: tuple[bytes, list]) -> bytes:
    """Digests in order, each after the number of its children, but for the leaves of a paragraph, whose number is known."""
    parts = [_number(len(root[1])), root[0]]
    for digest, paragraphs in root[1]:
        parts += (_number(len(paragraphs)), digest)
        for node in paragraphs:
            if isinstance(node, bytes):
                parts += (b"\0", node)
            else:
                parts += (_number(len(node[1])), node[0], *node[1])
    return b"".join(parts)


def decode(fingerprint: bytes) -> tuple[bytes, list]:
    at = 0

    def number() -> int:
        nonlocal at
        many = shift = 0
        while True:
            byte = fingerprint[at]
            at += 1
            many |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return many

    def digest(size: int) -> bytes:
        nonlocal at
        at += size
        return fingerprint[at - size : at]

    def paragraph() -> Node:
        many = number()
        return (digest(INNER), [digest(LEAF) for _ in range(many)]) if many else digest(LEAF)

    def section() -> Node:
        many = number()
        return digest(INNER), [paragraph() for _ in range(many)]

    many = number()
    return digest(ROOT), [section() for _ in range(many)]


def fingerprint(text: bytes) -> bytes:
    return encode(tree(text))


def _weight(node: Node) -> int:
    return int(node != BLANK) if isinstance(node, bytes) else sum(map(_weight, node[1]))


def _name(node: Node) -> bytes:
    return node if isinstance(node, bytes) else node[0]


def likeness(a: tuple[bytes, list], b: tuple[bytes, list]) -> float:
    """Between 0 and 1: equal roots have 1, others the share of leaves they have in common (Dice), below 1. Only branches that the other has nowhere are gone into."""
    if a[0] == b[0]:
        return 1.0
    total, shared = _weight(a) + _weight(b), 0
    x, y = a[1], b[1]
    while x and y:
        both = Counter(map(_name, x)) & Counter(map(_name, y))
        rest: list[list[Node]] = []
        for k, nodes in enumerate((x, y)):
            left, below = both.copy(), []
            for node in nodes:
                if left[_name(node)] > 0:
                    left[_name(node)] -= 1
                    shared += _weight(node)
                elif not isinstance(node, bytes):
                    below += node[1]
                else:
                    below.append(node)
            rest.append(below)
        if all(isinstance(node, bytes) for nodes in (x, y) for node in nodes):
            break
        x, y = rest
    return min(shared / total, 1 - 1 / (total + 1)) if total else 0.0


def branches(a: tuple[bytes, list], b: tuple[bytes, list], path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], int, int, int]]:
    """Differing branches: the path to their parent, the first child that differs, and how many do in the first tree and in the second.

    Equal children at both ends are passed over; of those between, as many in both trees, each pair that differs is gone into.
    """
    x, y = a[1], b[1]
    head, least = 0, min(len(x), len(y))
    while head < least and _name(x[head]) == _name(y[head]):
        head += 1
    tail = 0
    while tail < least - head and _name(x[-1 - tail]) == _name(y[-1 - tail]):
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(p) != len(q):
        return [(path, head, len(p), len(q))]
    out: list[tuple[tuple[int, ...], int, int, int]] = []
    for k, (u, v) in enumerate(zip(p, q), head):
        if _name(u) != _name(v):
            if isinstance(u, tuple) and isinstance(v, tuple):
                out += branches(u, v, (*path, k))
            elif out and out[-1][0] == path and sum(out[-1][1:3]) == k:
                out[-1] = (path, out[-1][1], out[-1][2] + 1, out[-1][3] + 1)
            else:
                out.append((path, k, 1, 1))
    return out


_ROW = [
    ("doc_id", pa.int64(), T.LongType()), ("n_chars", pa.int64(), T.LongType()), ("edited", pa.binary(), T.BinaryType()), ("own", pa.binary(), T.BinaryType()), ("own_edited", pa.binary(), T.BinaryType()),
    ("near_edited", pa.float64(), T.DoubleType()), ("near_next", pa.float64(), T.DoubleType()), ("edited_branches", pa.int64(), T.LongType()), ("edited_from", pa.string(), T.StringType()),
]
ROW = T.StructType([T.StructField(name, kind) for name, _, kind in _ROW])
ENDS = T.StructType([*ROW.fields, T.StructField("part", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("head", "tail"))])
_ENDS = pa.schema([*((name, kind) for name, kind, _ in _ROW), ("part", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])


def edited_text(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of a text, and the text with its last third replaced by the beginning of the next."""
    points = text.decode("utf-8", "replace")
    third = len(points) // 3
    return len(points), (points[: len(points) - third] + following[: 4 * third].decode("utf-8", "ignore")[:third]).encode()


def compare(doc_id: int | None, text: bytes, following: bytes, own=None, other=None) -> tuple:
    """The row of a document and the one that follows it."""
    own, other = own or tree(text), other or tree(following)
    many, edited = edited_text(text, following)
    changed = tree(edited)
    differing = branches(own, changed) if own[0] != changed[0] else []
    begin = ".".join(map(str, (*differing[0][0], differing[0][1]))) if differing else None
    return doc_id, many, hashlib.sha256(edited).digest(), encode(own), encode(changed), likeness(own, changed), likeness(own, other), len(differing), begin


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the next; the last row, and a copy of the first, are left to ``_pair``."""
    part, head, last = TaskContext.get().partitionId(), None, None
    for batch in slices(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
            own = tree(text)
            if last is None:
                head = text
            else:
                rows.append(compare(*last[:2], text, last[2], own))
            last = doc_id, text, own
        columns = list(zip(*rows)) or [()] * len(_ROW)
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip([*columns, none, none, none], _ENDS)], schema=_ENDS)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "part": part, "head": head, "tail": last[1]}], schema=_ENDS)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compare(*x) for x in zip(batch.column("doc_id").to_pylist(), texts(batch, "tail"), texts(batch, "next_head"))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t, _) in zip(zip(*rows), _ROW)], names=ROW.names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_branches, edited_from``.

    The last two: how many branches of the edited text's tree differ, and the path to the first, a section's, paragraph's and leaf's number.
    Texts are whole, of any length; an empty table gives an empty result.

    Documents follow each other by descending id, null ids last and equal ids by a hash of the text; after the last comes
    the first, so a single row follows itself. Null texts are empty. The rows are dealt out by ranges of the order and walked in each;
    of each range only the first and last row meet the neighbouring ranges'.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    walked = stash(mapped(rows, _walk, ENDS), "merkle")
    ends = walked.where("part is not null").select("doc_id", "part", "head", "tail")
    by_part = Window.orderBy("part")  # one row a range, and no texts
    parts = ends.select("part").withColumn("following", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())))
    heads = ends.select(F.col("part").alias("following"), F.col("head").alias("next_head"))
    pairs = ends.join(parts, "part").join(heads, "following").select("doc_id", "tail", "next_head")
    every = walked.where("part is null").select(*ROW.names).unionByName(mapped(pairs, _pair, ROW))
    text = lambda c: F.lower(F.hex(c))
    return every.select(
        "doc_id", "n_chars", text("edited").alias("edited_sha256"), text("own").alias("fingerprint"), text("own_edited").alias("edited_fingerprint"), "near_edited", "near_next", "edited_branches", "edited_from",
    )


def op9_merkle(spark, sf_dir):
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """The rows of op9 for small inputs with distinct ids, likeness by whole lists of leaves."""
    rows = [(d, (t or "").encode()) for d, t in sorted(docs, reverse=True)]

    def leaves(node: Node) -> list[bytes]:
        return [node] * (node != BLANK) if isinstance(node, bytes) else [x for child in node[1] for x in leaves(child)]

    def near(a: bytes, b: bytes) -> float:
        x, y = leaves(decode(a)), leaves(decode(b))
        many = len(x) + len(y)
        return 1.0 if a[1 : 1 + ROOT] == b[1 : 1 + ROOT] else min(2 * sum((Counter(x) & Counter(y)).values()) / many, 1 - 1 / (many + 1)) if many else 0.0

    out = []
    for k, (d, text) in enumerate(rows):
        points, following = text.decode(), rows[(k + 1) % len(rows)][1].decode()
        third = len(points) // 3
        edited = (points[: len(points) - third] + following[:third]).encode()
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(following.encode())
        differing = branches(decode(a), decode(b))
        out.append((d, len(points), hashlib.sha256(edited).hexdigest(), a.hex(), b.hex(), near(a, b), near(a, c), len(differing), ".".join(map(str, (*differing[0][0], differing[0][1]))) if differing else None))
    return out
