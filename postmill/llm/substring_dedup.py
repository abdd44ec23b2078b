"""Substring dedup: windows of consecutive words that start earlier elsewhere are removed from later places.

Pass 1 hashes every window into count-min sketches, one a task, of ``ROWS`` rows; they are merged by cell
range into bit files (cell counted twice or more) in the shared folder. Cell counts never fall short, so pass 2 may skip
every window with a cell counted once: it groups exactly, by 96 bits of hash, only windows estimated
repeated. In a task only a window's first place can be the first of all; later ones are covered for sure,
so a passage in a third of all documents sends one row a task to its group. A third pass joins the covered
places, packed 64 to a number, to their documents and cuts the words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, fresh, mapped, new_dir, put_file, release, remove, slices, stash, texts

#: Sketch rows, cells for each expected window, cells in a merged file. A table of fewer cells has one file, of a power of two.
ROWS, CELLS_PER_WINDOW, SHARD_BITS = 2, 5, 24
#: Windows that a task holds before it passes on their first places.
HELD = 1 << 21

_PLAIN, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, flat), np.uint64, len(flat))


def rolled(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of ``n``, joined from runs of doubling length."""
    out, have, part, size, rest = None, 0, h, 1, n
    while rest:
        if rest & 1:
            if out is None:
                out, have = part, size
            else:  # the run so far, then the next ``size`` numbers
                many = len(h) - have - size + 1
                out, have = out[:many] * _power(factor, size) + part[have : have + many], have + size
        rest >>= 1
        if rest:
            many = len(h) - 2 * size + 1
            if many <= 0:
                return np.empty(0, np.uint64)
            part, size = part[:many] * _power(factor, size) + part[size : size + many], 2 * size
    return out


def _power(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(factor), n, 1 << 64))


def _windows(batch: pa.RecordBatch, n: int, second: bool):
    """Of a slice: row, start, and hashes of each window."""
    flat, sizes = [], []
    for text in texts(batch, "text"):
        words = text.split()
        sizes.append(len(words))
        flat += words
    sizes = np.array(sizes, np.int64)
    if len(flat) < n:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    h = word_hashes(flat)
    many = np.maximum(sizes - n + 1, 0)
    row = np.repeat(np.arange(len(sizes)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(sizes) - sizes, many) + start
    first = mixed(rolled(h, n, _PLAIN)[at])
    return row, start, first, mixed(rolled(mixed(h), n, _OTHER)[at]) if second else None


def _size(expected: float) -> tuple[int, int]:
    """Files of a sketch row and bits of a file's cells: the load of a cell stays the same at every size."""
    cells = expected * CELLS_PER_WINDOW
    if cells > 1 << SHARD_BITS:
        return math.ceil(cells / (1 << SHARD_BITS)), SHARD_BITS
    return 1, max(16, math.ceil(math.log2(max(1, cells))))


def _cells(key: np.ndarray, size: tuple[int, int], row: int) -> np.ndarray:
    """Cells of a row: the file by the upper half of a hash, the place in it by the lower."""
    shards, bits = size
    h = mixed(key ^ np.uint64(row))
    shard = (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return shard << np.uint64(bits) | h & np.uint64((1 << bits) - 1)


def _edges(cells: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Where the files begin and end in sorted cells."""
    return np.searchsorted(cells, np.arange(size[0] + 1, dtype=np.uint64) << np.uint64(size[1]))


def _sketch(n: int, size: tuple[int, int]):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in slices(batches, "text"):
            held.append(_windows(batch, n, False)[2])
            count += len(held[-1])
            if count >= 2 * HELD:
                yield from _sketched(np.concatenate(held), size)
                held, count = [], 0
        if count:
            yield from _sketched(np.concatenate(held), size)

    return sketch


def _sketched(key: np.ndarray, size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The cells that are set, by range: their gaps in Rice code, and a bit for counts of two or more."""
    for row in range(ROWS):
        cells = _cells(key, size, row)
        cells.sort()
        new = np.append(True, cells[1:] != cells[:-1])
        more = np.append(np.diff(np.flatnonzero(new)) > 1, cells[-1:] == cells[-2:-1] if len(cells) > 1 else False)
        cells = cells[new]
        edges = _edges(cells, size)
        out = []
        for shard, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                gap = np.diff(cells[a:b].astype(np.int64), prepend=shard << size[1])
                out.append((row, shard, *riced(gap), np.packbits(more[a:b]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["row", "shard", "many", "high", "low", "more"])


def riced(gap: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice code: of each number the low bits as they are, and the rest as so many zeros before a one."""
    k = int(np.log2(max(1.0, gap.mean())))
    high = np.zeros(int((gap >> k).sum()) + len(gap), np.uint8)
    high[np.cumsum((gap >> k) + 1) - 1] = 1
    low = (gap[:, None] >> np.arange(k) & 1).astype(np.uint8)
    return len(gap), np.packbits(high).tobytes(), bytes([k]) + np.packbits(low.ravel()).tobytes()


def unriced(many: int, high: bytes, low: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:many]
    k, low = low[0], np.unpackbits(np.frombuffer(low, np.uint8, offset=1))
    return (np.diff(ones, prepend=-1) - 1 << k) + low[: many * k].reshape(many, k) @ (1 << np.arange(k, dtype=np.int64))


def _merge(home: str, bits: int):
    def merge(part: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        row, shard = part.column("row")[0].as_py(), part.column("shard")[0].as_py()
        for many, high, low, more in zip(*(part.column(c).to_pylist() for c in ("many", "high", "low", "more"))):
            cells = np.cumsum(unriced(many, high, low))
            twice[cells[once[cells] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(cells)).astype(bool)]] = True
            once[cells] = True
        put_file(f"{home}/{row}-{shard}", np.packbits(twice, bitorder="little").tobytes())
        return pa.table({"row": pa.array([row], pa.int32()), "shard": pa.array([shard], pa.int64()), "twice": pa.array([int(twice.sum())], pa.int64())})

    return merge


def _bytes(data: memoryview) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


class Sketch:
    """The merged bit files, mapped as they are needed, and let go when they were not used for long."""

    def __init__(self, home: str, size: tuple[int, int]):
        self.home, self.size, self.files = home, size, Held()

    def twice(self, key: np.ndarray) -> np.ndarray:
        """Positions in ``key`` whose cells are all counted twice or more."""
        at = np.arange(len(key))
        for row in range(ROWS):
            cells = _cells(key[at], self.size, row)
            order = np.argsort(cells)
            cells, kept = cells[order], np.zeros(len(at), bool)
            edges = _edges(cells, self.size)
            for shard, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if a < b:
                    bits = self.files.get(f"{self.home}/{row}-{shard}", _bytes)
                    low = cells[a:b] & np.uint64((1 << self.size[1]) - 1)
                    kept[order[a:b]] = bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1
            at = at[kept]
        return at


_PLACES = pa.schema([("first", pa.int64()), ("second", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("later", pa.bool_())])


def _candidates(home: str, n: int, size: tuple[int, int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, count = Sketch(home, size), [], 0
        for batch in slices(batches, "text"):
            row, start, first, second = _windows(batch, n, True)
            at = sketch.twice(first)
            doc = np.asarray(batch.column("doc_id"))[row[at]]
            held.append((first[at].view(np.int64), (second[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), doc, start[at].astype(np.int32)))
            count += len(at)
            if count >= HELD:
                yield from _first_places(held)
                held, count = [], 0
        if count:
            yield from _first_places(held)

    return find


def _first_places(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Each window's first place here, and, under hashes of their own, the places that come later for sure."""
    first, second, doc, start = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((start, doc, second, first))
    first, second, doc, start = first[order], second[order], doc[order], start[order]
    same = np.append(False, (first[1:] == first[:-1]) & (second[1:] == second[:-1]))
    lead = np.flatnonzero(~same)
    lead = np.repeat(lead, np.diff(np.append(lead, len(first))))
    later = same & ((doc != doc[lead]) | (start != start[lead]))  # a repeated row is no later place
    own = mixed(doc.astype(np.uint64) * _PLAIN + start.astype(np.uint64)).view(np.int64)
    kept = later | ~same
    first, second, doc, start, later = np.where(later, own, first)[kept], second[kept], doc[kept], start[kept], later[kept]
    for a in range(0, len(first), 1 << 17):
        cut = slice(a, a + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (first, second, doc, start, later)], schema=_PLACES)


def covered_places(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, places``: 64 window starts to a number, for documents with windows that start earlier elsewhere."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    # a word takes about six bytes; a longer text only fills the sketch more
    expected = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    size = _size(expected)
    home = new_dir(spark, "sketch")
    parts = mapped(docs.select("text"), _sketch(window, size), "row int, shard long, many int, high binary, low binary, more binary")
    merged = parts.groupBy("row", "shard").applyInArrow(_merge(home, size[1]), "row int, shard long, twice long")
    merged.agg(F.sum("twice")).collect()
    del parts, merged
    release(spark)
    found = mapped(docs, _candidates(home, window, size), "first long, second int, doc_id long, start int, later boolean")
    block = [(F.col("start") / 64).cast("int").alias("block"), F.expr("shiftleft(1L, start % 64)").alias("bit")]
    order = Window.partitionBy("first", "second").orderBy("doc_id", "start")
    covered = found.withColumn("turn", F.rank().over(order)).where("turn > 1 or later").select("doc_id", *block)
    packed = covered.groupBy("doc_id", "block").agg(F.bit_or("bit").alias("bits"))
    out = stash(packed.groupBy("doc_id").agg(F.collect_list(F.struct("block", "bits")).alias("places")), "covered")
    del found, covered, packed
    release(spark)
    remove(spark, home)
    return out


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _cut(n: int, keep: list[str], as_digest: bool, covered: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, removed, kept = [], [], []
            for text, places in zip(texts(batch, "text"), batch.column(covered).to_pylist()):
                words = text.split()
                gone = 0
                if places:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for p in places:
                        bits = np.unpackbits(np.array([p["bits"]], np.int64).view(np.uint8), bitorder="little")
                        starts = np.flatnonzero(bits) + 64 * p["block"]
                        starts = starts[starts + n <= len(words)]
                        edge[starts] += 1
                        edge[starts + n] -= 1
                    out = np.cumsum(edge)[:-1] > 0
                    gone = int(out.sum())
                    words = [words[k] for k in np.flatnonzero(~out).tolist()]
                total.append(len(words) + gone)
                removed.append(gone)
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if as_digest else text.decode("utf-8", "replace"))
            columns = [batch.column(c) for c in keep] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *ADDED.names])

    return cut


def dedup_substrings(docs: DataFrame, window: int = 20, keep: list[str] | None = None, as_digest: bool = False) -> DataFrame:
    """Adds ``n_words, n_removed, kept`` to each row of ``docs`` (doc_id, text, ...).

    ``kept`` is the words left, joined by a space, or with ``as_digest`` its SHA-256. Null and empty texts have no
    words. A document of a null id has no place in the order: it keeps all, and nothing is held against it. Rows that
    repeat a doc_id are one document: equal windows at equal starts in them are one place. ``keep`` names the
    input columns to return (default all); those with the names of added ones are replaced.
    """
    plain = docs.drop(*ADDED.names)
    keep = plain.columns if keep is None else keep
    need = plain.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    doc, places = fresh("_doc", need), fresh("_places", need)
    covered = covered_places(plain, window).select(F.col("doc_id").alias(doc), F.col("places").alias(places))
    joined = need.hint("shuffle_hash").join(covered.hint("shuffle_hash"), F.col("doc_id") == F.col(doc), "left").drop(doc)
    return mapped(joined, _cut(window, list(keep), as_digest, places), T.StructType([need.schema[c] for c in keep] + ADDED.fields))


def op6_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, keep=["doc_id"], as_digest=True).withColumnRenamed("kept", "kept_sha256")


#: The same rows by windows over all words: equal windows, the first of them by document and start, and the words that later ones cover.
OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM w),
k AS (SELECT *, string_agg(word, ' ') OVER ahead AS own, count(*) OVER ahead AS many FROM p WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY own ORDER BY doc_id, i) > 1 AS later FROM k WHERE many = 20),
c AS (SELECT doc_id, i, word, coalesce(bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN r USING (doc_id, i)),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
"""


def brute_force(docs: list[tuple[int, str | None]], window: int = 20) -> list[tuple]:
    """The rows of op6 for small inputs with distinct ids."""
    seen, out = set(), []
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = set()
        for at in range(len(words) - window + 1):
            own = tuple(words[at : at + window])
            if own in seen:
                gone.update(range(at, at + window))
            seen.add(own)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
