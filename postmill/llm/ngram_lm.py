"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Keys (word hashes, then pairs of word numbers) are counted in a task, packed by shard and merged a shard at a time into a file of
sorted keys and counts in the shared folder. A word's number is its place in the sorted hashes. Sums for contexts
and continuations are merged by ranges of word numbers. Workers map these files and look up sorted batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Held, mapped, new_dir, put_file, slices, stash, texts
from .substring_dedup import mixed

#: Tokens a task counts at a time, tokens for a shard, and word numbers in a range.
CHUNK, SHARD_TOKENS, RANGE = 1 << 21, 1 << 21, 1 << 20
#: Stands for the end of a text among word hashes; no word is a line feed.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_CODEC = pa.Codec("zstd", 1)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, their bytes grouped by place and compressed."""
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.empty(0, np.uint64)
    raw = _CODEC.decompress(blob[8:], decompressed_size=size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, an end after each text, and the number of each text's tokens."""
    flat, sizes, digest = [], [], xxhash.xxh3_64_intdigest
    for text in texts(batch, "text"):
        words = text.translate(LOWER).split()
        sizes.append(len(words) + 1)
        flat += words
        flat.append(b"\n")
    return np.fromiter(map(digest, flat), np.uint64, len(flat)), np.array(sizes, np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    keys, counts = _sums(keys)
    order = np.argsort(shard_of(keys, bits), kind="stable")
    keys, counts = keys[order], counts[order]
    shard = shard_of(keys, bits)
    edges = np.searchsorted(shard, np.arange((1 << bits) + 1))
    full = np.flatnonzero(np.diff(edges))
    cut = [(edges[s], edges[s + 1]) for s in full]
    return pa.RecordBatch.from_arrays([
        pa.array(full, pa.int64()), pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cut], pa.binary()), pa.array([pack(counts[a:b]) for a, b in cut], pa.binary()),
    ], names=["shard", "keys", "counts"])


def _count(keys_of, bits: int):
    """``keys_of``: makes a function of a slice that returns its keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, keys = [], 0, keys_of()
        for batch in slices(batches, "text"):
            held.append(keys(batch))
            many += len(held[-1])
            if many >= CHUNK:
                yield _packed(np.concatenate(held), bits)
                held, many = [], 0
        if many:
            yield _packed(np.concatenate(held), bits)

    return count


def _merged(part: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in part.column("keys").to_pylist()]
    counts = [unpack(x) for x in part.column("counts").to_pylist()]
    return part.column("shard")[0].as_py(), *_sums(np.concatenate(keys), np.concatenate(counts))


def _store(home: str, name: str):
    def store(part: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(part)
        put_file(f"{home}/{name}-{shard}", keys.tobytes(), counts.tobytes())
        return pa.table({"shard": [shard], "many": [len(keys)], "total": [int(counts.sum())]})

    return store


def _halves(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _numbers(data: memoryview) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _sums_of(data: memoryview) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(6, -1)


@dataclass
class Model:
    """What workers need to open the files: few numbers, whatever the corpus. The file ``first`` has the number of each word shard's first word."""

    home: str
    bits: int  # of shards of words and of pairs
    words: int
    tokens: int
    discounts: tuple[tuple[float, float, float], ...] = ()  # of continuation counts, of pair counts
    types: int = 0
    rest: float = 1.0
    span: int = RANGE


class Reader:
    """Maps a model's files as they are needed, and lets those go that were not used for long."""

    def __init__(self, model: Model):
        self.model, self.files = model, Held()

    def _file(self, name: str, parse, optional: bool = False):
        return self.files.get(f"{self.model.home}/{name}", parse, optional)

    def _by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = shard_of(keys, self.model.bits)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
            yield int(shard[a]), order[a:b]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that training lacks."""
        own, back = np.unique(h, return_inverse=True)
        out = np.full(len(own), -1, np.int64)
        for s, at in self._by_shard(own):
            keys, _ = self._file(f"word-{s}", _halves, True)
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
                out[at] = np.where(keys[slot] == own[at], self._file("first", _numbers)[s] + slot, -1)
        return out[back]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        own, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(own))
        for s, at in self._by_shard(own):
            found, counts = self._file(f"pair-{s}", _halves, True)
            if len(found):
                slot = np.minimum(np.searchsorted(found, own[at]), len(found) - 1)
                out[at] = np.where(found[slot] == own[at], counts[slot], 0)
        return out[back]

    def sums(self, ids: np.ndarray) -> np.ndarray:
        """Six rows by number: count, continuations, followers' count, followers seen once, twice, more often. Zeros for -1."""
        own, back = np.unique(ids, return_inverse=True)
        out = np.zeros((6, len(own)))
        for r in np.unique(own[own >= 0] // self.model.span).tolist():
            at = np.flatnonzero((own >= r * self.model.span) & (own < (r + 1) * self.model.span))
            out[:, at] = self._file(f"range-{r}", _sums_of)[:, own[at] - r * self.model.span]
        return out[:, back]


def _pairs(ids: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers, with ``words`` for the start of a text, and the keys of context and word."""
    context = np.append(words, ids[:-1])
    context[np.cumsum(sizes)[:-1]] = words
    return context, context.astype(np.uint64) * np.uint64(words + 1) + ids.astype(np.uint64)


def _pair_keys(model: Model):
    def make():
        reader = Reader(model)

        def keys(batch: pa.RecordBatch) -> np.ndarray:
            h, sizes = hashes(batch)
            return _pairs(reader.ids(h), sizes, model.words)[1]

        return keys

    return make


def _word_keys():
    return lambda batch: hashes(batch)[0]


def _store_pairs(model: Model):
    """Stores a shard of pairs and passes on, by range, what it adds to the sums of contexts and words."""

    def store(part: pa.Table) -> pa.Table:
        shard, keys, counts = _merged(part)
        put_file(f"{model.home}/pair-{shard}", keys.tobytes(), counts.tobytes())
        context, word = keys // np.uint64(model.words + 1), keys % np.uint64(model.words + 1)
        many = counts.astype(np.int64)
        of_counts = [int((many == k).sum()) for k in (1, 2, 3, 4)]
        ids, at = np.unique(context, return_inverse=True)
        sums = [np.bincount(at, many), np.bincount(at, many == 1), np.bincount(at, many == 2), np.bincount(at, many > 2)]
        tails, types = _sums(word)
        rows = []
        for kind, own, values in ((0, ids, sums), (1, tails, [types])):
            edges = np.searchsorted(own, np.arange(0, model.words // model.span + 2, dtype=np.uint64) * np.uint64(model.span))
            for r in np.flatnonzero(np.diff(edges)).tolist():
                cut = slice(edges[r], edges[r + 1])
                rows.append((r, kind, pack(np.diff(own[cut], prepend=np.uint64(r * model.span))), pack(np.concatenate([np.asarray(v[cut], np.uint64) for v in values]))))
        none = [None] * len(rows)
        return pa.table({
            "range": pa.array([x[0] for x in rows] + [None], pa.int64()), "kind": pa.array([x[1] for x in rows] + [None], pa.int32()),
            "keys": pa.array([x[2] for x in rows] + [None], pa.binary()), "sums": pa.array([x[3] for x in rows] + [None], pa.binary()),
            "shard": pa.array([*none, shard], pa.int64()), "of_counts": pa.array([*none, of_counts], pa.list_(pa.int64())),
        })

    return store


def _store_range(model: Model):
    def store(part: pa.Table) -> pa.Table:
        files = Held()
        starts = files.get(f"{model.home}/first", _numbers)  # one more than there are shards; an empty shard begins where the next does
        r = part.column("range")[0].as_py()
        low = r * model.span
        size = min(model.span, model.words + 1 - low)
        out = np.zeros((6, size))
        for shard in range(max(0, int(np.searchsorted(starts, low, "right")) - 1), int(np.searchsorted(starts, low + size))):
            first, last = int(starts[shard]), int(starts[shard + 1]) if shard + 1 < len(starts) else model.words
            a, b = max(first, low), min(last, low + size)
            if a < b:
                out[0, a - low : b - low] = files.get(f"{model.home}/word-{shard}", _halves)[1][a - first : b - first]
        for kind, keys, sums in zip(*(part.column(c).to_pylist() for c in ("kind", "keys", "sums"))):
            own = np.cumsum(unpack(keys), dtype=np.uint64).astype(np.int64)  # from the start of the range
            rows = [1] if kind else [2, 3, 4, 5]
            out[np.ix_(rows, own)] += unpack(sums).reshape(len(rows), -1)
        put_file(f"{model.home}/range-{r}", out.tobytes())
        types = out[1, : min(size, max(0, model.words - low))]
        return pa.table({"range": [r], "types": [int(types.sum())], "n": pa.array([[int((types == k).sum()) for k in (1, 2, 3, 4)] + [int((types > 2).sum())]], pa.list_(pa.int64()))})

    return store


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's, from the numbers of keys counted once to four times; where those are too few, 0.5, 1 and 1.5."""
    if not all(n[:4]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 1.0) for k in range(3))


def train(texts_of: DataFrame, span: int = RANGE) -> Model:
    """Counts the column ``text`` of all rows, whole texts of any length; null is empty, and counts its end. Rows that repeat are counted each time. An empty table gives a model
    of no words, under which every text scores 0. Other columns are not read, whatever their names.
    """
    spark = texts_of.sparkSession
    size = texts_of.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / SHARD_TOKENS)))))
    home = new_dir(spark, "lm")
    rows = "shard long, keys binary, counts binary"
    source = texts_of.select("text")
    words = mapped(source, _count(_word_keys, bits), rows).groupBy("shard").applyInArrow(_store(home, "word"), "shard long, many long, total long").toArrow()
    many = np.zeros(1 << bits, np.int64)  # three numbers a shard of 2^21 tokens come to the driver
    many[np.asarray(words.column("shard"))] = np.asarray(words.column("many"))
    first = np.append(0, np.cumsum(many))
    if first[-1] >= 1 << 32:
        raise ValueError("the vocabulary is beyond 2^32 words: pairs of word numbers no longer fit in 64 bits")
    model = Model(home, bits, int(first[-1]), int(np.asarray(words.column("total")).sum()), span=span)
    if not model.words:
        return model
    put_file(f"{home}/first", first.tobytes())
    out = "range long, kind int, keys binary, sums binary, shard long, of_counts array<long>"
    found = mapped(source, _count(_pair_keys(model), bits), rows).groupBy("shard").applyInArrow(_store_pairs(model), out)
    found = stash(found, "lm-sums")
    ranges = found.where("range is not null").select("range", "kind", "keys", "sums").groupBy("range").applyInArrow(_store_range(model), "range long, types long, n array<long>")
    added = lambda name, many: [F.sum(F.get(name, F.lit(k))).alias(f"n{k}") for k in range(many)]
    *n_type, model.types = (x or 0 for x in ranges.agg(*added("n", 5), F.sum("types")).first())
    n_pair = [x or 0 for x in found.where("shard is not null").agg(*added("of_counts", 4)).first()]
    model.discounts = discounts(n_type), discounts(n_pair)
    d = model.discounts[0]
    model.rest = (d[0] * n_type[0] + d[1] * n_type[1] + d[2] * n_type[4]) / model.types
    return model


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts without their discount."""
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0)


def probabilities(model: Model, reader: Reader, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: its training count and its probability after the one before."""
    if not model.words:
        return np.zeros(len(h)), np.ones(len(h))
    ids = reader.ids(h)
    context, keys = _pairs(ids, sizes, model.words)
    own = reader.sums(ids)
    p = _less(own[1], model.discounts[0]) / model.types + model.rest / (model.words + 1)
    before = reader.sums(context)
    d = model.discounts[1]
    seen = before[2] > 0
    total = np.where(seen, before[2], 1)
    backoff = np.where(seen, (d[0] * before[3] + d[1] * before[4] + d[2] * before[5]) / total, 1)
    both, pair = np.flatnonzero(seen & (ids >= 0)), np.zeros(len(ids))
    pair[both] = reader.pair_counts(keys[both])
    return own[0], _less(pair, d) / total + backoff * p


ADDED = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds to the columns ``keep`` of every row the figures of its ``text``; scores are log10 probabilities, ends included.

    A null text is empty: it has its end as its one token. Rows that repeat get equal figures; an empty table gives an empty result.
    ``keep`` must not name the columns that are added; all others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in slices(batches, "text"):
            h, sizes = hashes(batch)
            counts, p = probabilities(model, reader, h, sizes)
            begin = np.cumsum(sizes) - sizes
            base = np.log10((counts + 1) / (model.tokens + 1 * (model.words + 1)))
            known = np.add.reduceat((counts > 0).astype(np.int64), begin)
            added = [pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.tokens)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(np.log10(p), begin))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], names=[*keep, *ADDED])

    need = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*(f"`{c}` {need.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return mapped(need, run, schema)


def held_out(doc_id: Column, of: int = 7, turn: int = 2) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == turn, F.lit(False))


def op2_lm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])


def brute_force(docs: list[tuple[int, str | None]], train_on: set[int]) -> dict[int, tuple]:
    """n_tokens, n_known, train_tokens, base_score, score by id, from plain dictionaries."""
    from collections import Counter, defaultdict
    from math import log10

    tokens = {d: [*(text or "").encode().translate(LOWER).split(), b"\n"] for d, text in docs}
    one, two, followers = Counter(), Counter(), defaultdict(Counter)
    for d in train_on:
        one.update(tokens[d])
        for pair in zip([None, *tokens[d]], tokens[d]):
            two[pair] += 1
    for (a, b), c in two.items():
        followers[a][b] = c
    types = Counter(b for _, b in two)
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d1, d2 = discounts(of(types)), discounts(of(two))
    less = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)
    n, v, t = sum(one.values()), len(one), sum(types.values())
    rest = sum(d1[min(c, 3) - 1] for c in types.values()) / t
    out = {}
    for d, own in tokens.items():
        total = base = 0.0
        for a, b in zip([None, *own], own):
            p = less(types[b], d1) / t + rest / (v + 1)
            if a in followers:
                c = sum(followers[a].values())
                p = less(followers[a][b], d2) / c + sum(d2[min(x, 3) - 1] for x in followers[a].values()) / c * p
            total, base = total + log10(p), base + log10((one[b] + 1) / (n + 1 * (v + 1)))
        out[d] = (len(own), sum(one[w] > 0 for w in own), n, base, total)
    return out
