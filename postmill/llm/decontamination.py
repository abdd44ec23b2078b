"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``window`` consecutive words. A window's tokens are its word shingles, ordered
by how often they occur in all documents. Containment must be whole, so the necessary prefix of a window
is its one rarest shingle: documents are joined to windows on that shingle only. Where it occurs, the window can
start at one place; length and position bounds discard starts outside the document, and the words are compared, by 64 bits of hash each.
Documents are read twice, whatever the benchmark's size: to count its shingles, and to be judged. Its shingles, then its windows by
their prefix, are sorted arrays in files of the shared folder that workers map as they need them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Held, mapped, new_dir, put_file, slices, stash, texts
from .substring_dedup import mixed, rolled

#: Bytes of benchmark text for each index file, and shingles that a task counts before it passes them on.
PART_BYTES, COUNTED = 16 << 20, 1 << 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def hashes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice, and the number of each text's words."""
    flat, sizes, digest = [], [], xxhash.xxh3_64_intdigest
    for text in texts(batch, column):
        words = text.translate(ALNUM).split()
        sizes.append(len(words))
        flat += words
    return np.fromiter(map(digest, flat), np.uint64, len(flat)), np.array(sizes, np.int64)


def rooms(sizes: np.ndarray) -> np.ndarray:
    """Of each word: how many there are from it to its text's end."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())


def shingles(h: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of all runs of ``n`` words of one text."""
    if len(h) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(room[: len(h) - n + 1] >= n)
    return at, mixed(rolled(h, n, _FACTOR)[at] + np.uint64(n)).view(np.int64)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each file that has any."""
    if parts == 1:
        yield 0, np.arange(len(keys))
        return
    own = keys % parts
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        yield part, order[edges[part] : edges[part + 1]]


def _windows(window: int):
    """Rows of a window's word hashes and its item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            h, sizes = hashes(batch)
            room = rooms(sizes)
            item, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.minimum(sizes, window), sizes)
            at = np.flatnonzero(room >= size)
            words = [h[a : a + n].tobytes() for a, n in zip(at.tolist(), size[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column("item_id").take(pa.array(item[at]))], names=["words", "item_id"])

    return run


def _shingled(shingle: int, parts: int):
    """Of each window: its shingles' length, keys and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
            lengths = np.array([min(shingle, len(x)) for x in h])
            found = [shingles(x, np.arange(len(x), 0, -1), n) for x, n in zip(h, lengths.tolist())]
            many = np.array([len(at) for at, _ in found])
            keys = np.concatenate([k for _, k in found]) if found else np.empty(0, np.int64)
            at = np.concatenate([a for a, _ in found]).astype(np.int32) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("words").take(pa.array(np.repeat(np.arange(len(h)), many))), pa.array(np.repeat(lengths, many).astype(np.int32)), pa.array(keys), pa.array(keys % parts), pa.array(at)], names=["words", "n", "key", "part", "place"])

    return run


def _store_keys(uri: str):
    def store(part: pa.Table) -> pa.Table:
        put_file(f"{uri}/keys-{part.column('part')[0].as_py()}", np.sort(np.asarray(part.column("key"))).tobytes())
        return part.select(["part"]).slice(0, 1)

    return store


def _store_index(uri: str, window: int):
    """Windows in the order of their prefix, as an Arrow file."""

    def store(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        words = part.column("words").to_pylist()
        padded = pa.array([w.ljust(8 * window, b"\0") for w in words], pa.binary(8 * window))
        table = pa.table({"key": part.column("key"), "place": part.column("place"), "long": pa.array([len(w) // 8 for w in words], pa.int32()), "words": padded, "items": part.column("items")}).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        put_file(f"{uri}/index-{part.column('part')[0].as_py()}", sink.getvalue().to_pybytes())
        return part.select(["part"]).slice(0, 1)

    return store


class Index:
    """A mapped index file."""

    def __init__(self, data: memoryview, window: int):
        table = pa.ipc.open_file(pa.py_buffer(data)).read_all() if len(data) else None
        none = np.empty(0, np.int64)
        self.key, self.place, self.long = (np.asarray(table.column(c)) for c in ("key", "place", "long")) if table else (none,) * 3
        words = table.column("words").combine_chunks() if table else None
        self.words = np.frombuffer(words.buffers()[1], np.uint64).reshape(-1, window)[words.offset :][: len(words)] if table else np.empty((0, window), np.uint64)
        self.items = table.column("items") if table else None

    def hits(self, keys: np.ndarray, at: np.ndarray, h: np.ndarray, room: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence. ``begin``: of each word, where its text begins."""
        first = np.searchsorted(self.key, keys)
        found = np.flatnonzero(self.key[np.minimum(first, len(self.key) - 1)] == keys) if len(self.key) else np.empty(0, np.int64)
        first, at = first[found], at[found]
        many = np.searchsorted(self.key, keys[found], "right") - first
        w = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = np.repeat(at, many)
        start = at - self.place[w]
        inside = (start >= begin[at]) & (self.place[w] + room[at] >= self.long[w])
        w, start = w[inside], start[inside]
        for k in range(self.words.shape[1]):
            right = (self.long[w] <= k) | (h[np.minimum(start + k, len(h) - 1)] == self.words[w, k])
            w, start = w[right], start[right]
        return start, w


def _counter(uri: str, parts: int, lengths: list[int]):
    """Of the benchmark's shingles: those that documents hold, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, many = Held(), [], 0
        for batch in slices(batches, "text"):
            h, sizes = hashes(batch)
            room = rooms(sizes)
            for n in lengths:
                _, keys = shingles(h, room, n)
                for part, own in by_part(keys, parts):
                    known, own = files.get(f"{uri}/keys-{part}", lambda x: np.frombuffer(x, np.int64), True), keys[own]
                    if len(known):
                        held.append(own[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own])
                        many += len(held[-1])
            if many >= COUNTED:
                yield _counts(held)
                held, many = [], 0
        if many:
            yield _counts(held)

    return run


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], names=["key", "many"])


def build_index(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, part_bytes: int) -> tuple[str, int, list[int]]:
    """The folder of the index, its number of files, and the lengths of shingles in it. Rarity is counted over all ``docs``, in one pass."""
    uri = new_dir(docs.sparkSession, "benchmark")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / part_bytes))
    windows = mapped(items, _windows(window), "words binary, item_id string").groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = stash(windows, "benchmark-windows")
    keyed = stash(mapped(windows.select("words"), _shingled(shingle, parts), "words binary, n int, key long, part long, place int"), "benchmark-shingles")
    lengths = sorted(r.n for r in keyed.select("n").distinct().collect())
    keyed.select("part", "key").distinct().groupBy("part").applyInArrow(_store_keys(uri), "part long").count()
    counts = mapped(docs.select("text"), _counter(uri, parts, lengths), "key long, many long").groupBy("key").agg(F.sum("many").alias("many"))
    rarest = keyed.join(stash(counts, "benchmark-counts"), "key", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "key", "place", "part")).alias("its"))
    chosen = rarest.join(windows, "words").select("its.key", "its.place", "its.part", "words", "items")
    chosen.groupBy("part").applyInArrow(_store_index(uri, window), "part long").count()
    return uri, parts, lengths


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, keep: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds ``n_words, n_hit, item_ids, hit_spans`` to each row of ``docs`` (text, ...); spans are in words, merged.

    An item of fewer than ``window`` words is one window; one without words, or with a null id or text, is none.
    Null and empty documents have no words; rows that repeat are judged alike; an empty benchmark hits nothing;
    items that repeat an id count once. Texts are read whole, whatever their length. ``keep`` names the input columns to return (default all); those
    with the names of added ones are replaced.
    """
    plain = docs.drop(*ADDED.names)
    keep = [c for c in (plain.columns if keep is None else keep)]
    uri, parts, lengths = build_index(plain, benchmark, window, shingle, part_bytes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Held()
        for batch in slices(batches, "text"):
            h, sizes = hashes(batch)
            room, begins = rooms(sizes), np.cumsum(sizes) - sizes
            begin, edge, items = np.repeat(begins, sizes), np.zeros(len(h) + 1, np.int64), {}
            for n in lengths:
                at, keys = shingles(h, room, n)
                for part, own in by_part(keys, parts):
                    index = files.get(f"{uri}/index-{part}", lambda x: Index(x, window), True)
                    start, w = index.hits(keys[own], at[own], h, room, begin)
                    if len(w):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + index.long[w], -1)
                        doc = np.searchsorted(begins, start, "right") - 1
                        for d, k in np.unique(np.stack([doc, w], 1), axis=0).tolist():
                            items.setdefault(d, set()).update(index.items[k].as_py())
            total = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
            n_hit, hit, spans = total[begins + sizes] - total[begins], np.diff(total), [[]] * len(sizes)
            for d in np.flatnonzero(n_hit).tolist():
                own = np.diff(np.concatenate([[0], hit[begins[d] : begins[d] + sizes[d]], [0]]))
                spans[d] = [{"start": a, "stop": b} for a, b in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())]
            columns = [batch.column(c) for c in keep] + [pa.array(sizes), pa.array(n_hit), pa.array([sorted(items.get(d, ())) for d in range(len(sizes))], pa.list_(pa.string())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *ADDED.names])

    need = plain.select(*dict.fromkeys([*keep, "text"]))
    return mapped(need, judge, T.StructType([need.schema[c] for c in keep] + ADDED.fields))


def op5_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_OWN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _runs(n: int, table: str) -> str:
    """Runs of ``n`` words of a text, with their start."""
    return f"SELECT id, i, {n} AS n, string_agg(word, ' ') OVER ahead AS own, count(*) OVER ahead AS many FROM {table} WINDOW ahead AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


#: The same rows by runs of 1 to 10 words of all texts.
OP5_SQL = rf"""
WITH b AS (SELECT item_id::VARCHAR AS id, {_OWN} AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL), d AS (SELECT doc_id AS id, {_OWN} AS t FROM documents),
bw AS (SELECT id, least(len(t), 10) AS size, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM b), dw AS (SELECT id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM d),
bs AS ({' UNION ALL '.join(f"SELECT id, n, own FROM ({_runs(n, f'(SELECT * FROM bw WHERE size = {n})')}) WHERE many = n" for n in range(1, 11))}),
ds AS ({' UNION ALL '.join(f"SELECT id, i, n, own FROM ({_runs(n, f'(SELECT * FROM dw WHERE {n} IN (SELECT size FROM bw))')}) WHERE many = n" for n in range(1, 11))}),
m AS (SELECT ds.id, ds.i, ds.n, bs.id AS item FROM ds JOIN bs USING (n, own)),
h AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS place FROM m) GROUP BY id), x AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY id)
SELECT d.id AS doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (id) LEFT JOIN x USING (id)
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """The rows of op5 for small inputs, window by window."""
    windows = []
    for item, text in items:
        words = (text or "").encode().translate(ALNUM).split()
        windows += [(str(item), words[k : k + window]) for k in range(max(1, len(words) - window + 1))] if words else []
    out = []
    for doc, text in docs:
        words, hit, found = (text or "").encode().translate(ALNUM).split(), set(), set()
        for item, w in windows:
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    found.add(item)
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
