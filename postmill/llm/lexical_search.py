"""Ranked lexical search over a two-level quantised index.

The index is cut by documents into shards of a few MB of text, one row each. Its first level has, for every term, the shard's
documents and their impacts, rounded up to a byte; its second level the exact counts and lengths. A search adds up bytes, which bound every
document's score from above and below. Documents whose upper bound reaches the kth greatest lower bound, or the kth score of
the task so far, are scored again in exact integers; the others can't be among the first k. A task keeps k documents an item, so what is
shuffled doesn't grow with the documents, and no list of a common term is ever gathered.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Held, fresh, mapped, new_dir, put_file, slices, stash, table, texts

#: An impact is below 1,000,000; a byte counts ``STEP`` of it.
STEP = -(-1_000_000 // 255)
#: Items of a block, which are scored together; blocks of a pass over the index; terms of a file whose documents are counted; bytes of a text read at a time.
BLOCK, BLOCKS, COUNTED, PIECE = 128, 64, 1 << 20, 4 << 20
LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some MB at a time."""
    text, start = text.translate(ALNUM), 0
    while start < len(text):
        stop = text.find(b" ", start + PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes each; the first byte tells how many."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + x.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def postings(own: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of some texts: hashes of the terms, in order; where each term's postings end; their texts and counts; terms of each text."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    ids = [[np.fromiter(map(vocabulary.__getitem__, part), np.int64, len(part)) for part in terms(text)] for text in own]
    n = np.array([sum(map(len, x)) for x in ids], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *(x for part in ids for x in part)])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    order = np.argsort(hashes)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keys, tf = np.unique(rank[flat] * len(own) + np.repeat(np.arange(len(own)), n), return_counts=True)
    return hashes[order], np.searchsorted(keys, np.arange(1, len(order) + 1) * len(own)), keys % max(1, len(own)), tf, n


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n = [sum(map(len, terms(text))) for text in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))]), pa.array([sum(n)])], names=["documents", "terms"])


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m. Python's numbers, as ``n`` times all documents may pass 64 bits."""
    return np.array([25 + 75 * x * documents // max(1, total) for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


INDEX = "terms binary, ends binary, docs binary, impacts binary, tf binary, m binary, ids array<long>"


def _shards(documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, ends, docs, tf, n = postings(texts(batch, "text"))
            m = lengths(n, documents, total)
            upward = -(-impacts(tf, m[docs]) // STEP)
            columns = [hashes.tobytes(), packed(ends), packed(docs), upward.astype(np.uint8).tobytes(), packed(tf), packed(m)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in columns), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))], names=[x.split()[0] for x in INDEX.split(", ")])

    return run


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index of ``doc_id, text``, the number of documents with a term, and of all their terms. Texts are read twice: for these numbers, on which impacts depend, and for the index."""
    got = mapped(docs.select("text"), _totals, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = got[0] or 0, got[1] or 0
    return stash(mapped(docs.select("doc_id", "text"), _shards(documents, total), INDEX), "lexical-index"), documents, total


def _query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, ends, item, tf, _ = postings(texts(batch, "text"))
        own = hashes.view(np.int64)[np.repeat(np.arange(len(hashes)), np.diff(ends, prepend=0))]
        yield pa.RecordBatch.from_arrays([batch.column("_item").take(pa.array(item)), pa.array(own), pa.array(tf.astype(np.int64))], names=["item", "term", "many"])


def _store_terms(uri: str):
    def store(part: pa.Table) -> pa.Table:
        put_file(f"{uri}/terms-{part.column('part')[0].as_py()}", np.sort(np.asarray(part.column("term")).view(np.uint64)).tobytes())
        return part.select(["part"]).slice(0, 1)

    return store


def within(known: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of numbers that both sorted arrays hold, in each."""
    at = np.searchsorted(known, own)
    found = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == own) if len(known) else np.empty(0, np.int64)
    return at[found], found


def _frequencies(uri: str, parts: int):
    """Documents of each term that an item asks for, summed over the task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, sums = Held(), {}
        for batch in batches:
            for hashes, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
                hashes, many = np.frombuffer(hashes, np.uint64), np.diff(unpacked(ends).astype(np.int64), prepend=0)
                for part in range(parts):
                    asked = files.get(f"{uri}/terms-{part}", lambda x: np.frombuffer(x, np.uint64), True)
                    own, at = within(hashes, asked)
                    sums.setdefault(part, np.zeros(len(asked), np.int64))[at] += many[own]
        for part, own in sums.items():
            asked, at = files.get(f"{uri}/terms-{part}", lambda x: np.frombuffer(x, np.uint64), True), np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(asked[at].view(np.int64)), pa.array(own[at])], names=["term", "df"])

    return run


def _store_block(uri: str):
    def store(part: pa.Table) -> pa.Table:
        part = part.sort_by([("term", "ascending"), ("item", "ascending")])
        columns = [np.asarray(part.column(c)).astype(np.int64) for c in ("term", "item", "weight")]
        put_file(f"{uri}/block-{part.column('block')[0].as_py()}", *(x.tobytes() for x in columns))
        return part.select(["block"]).slice(0, 1)

    return store


class Block:
    """Items that are scored together: weight times count by term, of each item."""

    def __init__(self, data: memoryview):
        term, item, self.weight = np.frombuffer(data, np.int64).reshape(3, -1) if len(data) else np.empty((3, 0), np.int64)
        self.items, self.item = np.unique(item, return_inverse=True)
        order = np.argsort(term.view(np.uint64), kind="stable")
        self.terms, begin = np.unique(term.view(np.uint64)[order], return_index=True)
        self.weight, self.item, self.begin = self.weight[order], self.item[order], np.append(begin, len(order))


class Shard:
    """A row of the index. The second level is unpacked when it is needed."""

    def __init__(self, row: dict):
        self.row, self.ids = row, np.array([LAST if x is None else x for x in row["ids"]], np.int64)
        self.terms, self.ends = np.frombuffer(row["terms"], np.uint64), unpacked(row["ends"]).astype(np.int64)
        self.docs, self.impacts = unpacked(row["docs"]), np.frombuffer(row["impacts"], np.uint8)
        self.exact: tuple[np.ndarray, np.ndarray] | None = None

    def search(self, block: Block, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each item of the block that has any: the places and scores of all documents that may be among the first ``k``; ``least``: the kth score elsewhere, or 0."""
        own, at = within(self.terms, block.terms)
        if not len(own):
            return
        begin = np.where(own, self.ends[own - 1], 0)
        bound = np.zeros((len(block.items), len(self.ids)), np.int64)
        sure = np.zeros_like(bound)
        for t, a, b in zip(at.tolist(), begin.tolist(), self.ends[own].tolist()):
            asked = slice(block.begin[t], block.begin[t + 1])
            cells, weight = np.ix_(block.item[asked], self.docs[a:b]), block.weight[asked, None]
            bound[cells] += weight * self.impacts[a:b].astype(np.int64)
            sure[cells] += weight
        bound *= STEP
        if len(self.ids) >= k:
            lower = bound - (STEP - 1) * sure
            least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        candidates = (bound > 0) & (bound >= least[:, None])
        rows = np.flatnonzero(candidates.any(axis=1))
        if not len(rows):
            return
        if self.exact is None:
            self.exact = unpacked(self.row["tf"]), unpacked(self.row["m"]).astype(np.int64)
        by_item = defaultdict(list)
        for t, a, b in zip(at.tolist(), begin.tolist(), self.ends[own].tolist()):
            for x in range(block.begin[t], block.begin[t + 1]):
                by_item[block.item[x]].append((a, b, block.weight[x]))
        tf, m = self.exact
        for item in rows.tolist():
            docs = np.flatnonzero(candidates[item])
            score = np.zeros(len(docs), np.int64)
            for a, b, weight in by_item[item]:
                place, found = within(self.docs[a:b], docs)
                score[found] += weight * impacts(tf[a:b][place].astype(np.int64), m[docs[found]])
            yield item, docs, score


def _search(uri: str, blocks: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, best = Held(), {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                for number in blocks:
                    block = files.get(f"{uri}/block-{number}", Block, True)
                    if number not in best:
                        best[number] = np.zeros(len(block.items), np.int64), {}
                    least, held = best[number]
                    for item, docs, score in shard.search(block, k, least):
                        ids, scores = np.append(held[item][0], shard.ids[docs]) if item in held else shard.ids[docs], np.append(held[item][1], score) if item in held else score
                        first = np.lexsort((ids, -scores))[:k]
                        first = first[scores[first] > 0]
                        held[item] = ids[first], scores[first]
                        if len(first) == k:
                            least[item] = scores[first[-1]]
        for number, (_, held) in best.items():
            items = files.get(f"{uri}/block-{number}", Block, True).items
            for item, (ids, scores) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items[item], len(ids))), pa.array(ids, mask=ids == LAST), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * df + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """Each row of ``items`` (item_id, text, ...) with its ``k`` documents of ``docs`` (doc_id, text) of highest score above 0: all columns of items but the text, and ``doc_id, score, rank``.

    Null and empty texts have no term: such a document isn't found and isn't counted, such an item finds nothing. Equal scores go by doc_id,
    a null doc_id last; repeated documents are found each, repeated items get their rows each. Empty tables give no rows. Texts of any
    length are read whole. Terms are compared by 64 bits of hash: of n distinct terms in all, one falls together with one of q that items ask for with a chance of
    q * n / 2^64, 1 in 18,000 at 10^6 and 10^9. Columns of ``items`` that are named like added ones are replaced.
    """
    index, documents, total = build_index(docs)
    key = fresh("_item", items)
    kept = stash(items.drop("rank", "doc_id", "score").withColumn(key, F.monotonically_increasing_id()), "lexical-items")
    asked = stash(mapped(kept.select(F.col(key).alias("_item"), "text"), _query, "item long, term long, many long"), "lexical-query")
    uri = new_dir(docs.sparkSession, "lexical-files")
    distinct = asked.select("term").distinct()
    parts = max(1, math.ceil(distinct.count() / COUNTED))
    distinct.withColumn("part", F.pmod("term", F.lit(parts))).groupBy("part").applyInArrow(_store_terms(uri), "part long").count()
    counted = mapped(index.select("terms", "ends"), _frequencies(uri, parts), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    blocks = max(1, math.ceil(kept.count() / block))
    weighed = asked.join(stash(counted, "lexical-counts"), "term").select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term", "item", (weight(F.col("df"), documents) * F.col("many")).alias("weight"))
    weighed.groupBy("block").applyInArrow(_store_block(uri), "block long").count()
    passes = [mapped(index, _search(uri, list(range(a, min(blocks, a + BLOCKS))), k), "item long, doc_id long, score long") for a in range(0, blocks, BLOCKS)]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = reduce(DataFrame.unionAll, passes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.drop("text").join(found.withColumnRenamed("item", key), key).drop(key)


def op12_lexical_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search(docs.select("doc_id", "text"), items.select("item_id", "text")).select("item_id", "rank", "doc_id", "score")


_OWN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same rows by scoring every document of every item.
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {_OWN} AS t FROM documents) WHERE len(t) > 0), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest({_OWN}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
m AS (SELECT item_id, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM m WHERE score > 0) WHERE rank <= 10
"""
