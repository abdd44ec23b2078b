"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm over a trie, for all languages and many words at once; a text's
is the product over its words. The piece probabilities are fitted by expectation maximisation on a bounded sample of labelled
texts, ``SAMPLE`` of each language; prediction reads whole texts.
"""

from __future__ import annotations

import base64
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_file, mapped, new_dir, put_file, slices, stash, texts

#: The vocabulary file: lines of base64 piece and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Texts of a language that are learned from at most, and the bytes of the longest one; a language of longer texts only is learned from its shortest.
SAMPLE, SAMPLE_BYTES = 250, 1 << 16
#: Bytes of the longest piece; longer words are cut in parts of so many bytes; words scored at a time; words a worker remembers.
PIECE, WORD_BYTES, AT_ONCE, HELD = 12, 48, 1 << 13, 1 << 18
ROUNDS, SMOOTH = 3, 0.02
#: The least probability of a piece. Each byte's share is scaled by ``BYTE``, so a word's sum is within 1e-288 and 1e288 whatever its bytes.
FLOOR, BYTE = 1e-12, 1e6
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, each after the space that word-initial pieces begin with. Number signs such as fractions are no letters."""
    out, runs = [], LETTERS.findall(text.lower())
    if not all(map(str.isalpha, runs)):
        runs = [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]
    for word in runs:
        word = b" " + word.encode("utf-8", "replace")
        if len(word) <= WORD_BYTES:
            out.append(word)
        else:
            out += [word[k : k + WORD_BYTES] for k in range(0, len(word), WORD_BYTES)]
    return out


class Trie:
    """Pieces by their bytes; every single byte is a piece."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({p for p in pieces if 0 < len(p) <= PIECE and p == p.lower() and re.fullmatch(rb" ?[a-z\x80-\xff]*", p)} | {bytes([b]) for b in range(256)})
        known = sorted({b for p in pieces if len(p) > 1 for b in p})
        self.kind = np.full(256, len(known), np.int32)  # bytes of no longer piece are all alike
        self.kind[known] = np.arange(len(known))
        children, ends = [{}], [-1]
        self.single = np.full(256, -1, np.int32)
        self.size, self.bytes = len(pieces), np.array([len(p) for p in pieces])
        for number, piece in enumerate(pieces):
            if len(piece) == 1:
                self.single[piece[0]] = number
            at = 0
            for k in (self.kind[b] for b in piece):
                if k == len(known):
                    break
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][k]
            else:
                ends[at] = number
        self.next = np.full((len(children), len(known) + 1), -1, np.int32)
        for at, own in enumerate(children):
            for k, child in own.items():
                self.next[at, k] = child
        self.ends = np.array(ends, np.int32)

    def matches(self, block: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, length, rows and pieces, by start. ``sizes`` falls, so the words beyond a column come last."""
        kinds = np.where(block >= 0, self.kind[np.maximum(block, 0)], len(self.next[0]) - 1)
        for start in range(block.shape[1]):
            rows = np.arange(np.searchsorted(-sizes, -start, "left"))
            if not len(rows):
                return
            yield start, 1, rows, self.single[block[rows, start]]
            node = self.next[0, kinds[rows, start]]
            for size in range(2, min(PIECE, block.shape[1] - start) + 1):
                alive = (node >= 0) & (sizes[rows] >= start + size)
                rows, node = rows[alive], node[alive]
                node = self.next[node, kinds[rows, start + size - 1]]
                alive = node >= 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.ends[node]
                hit = piece >= 0
                if hit.any():
                    yield start, size, rows[hit], piece[hit]


def _blocks(own: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``own``, longest first, their bytes with -1 behind, and their lengths."""
    order = np.array(sorted(range(len(own)), key=lambda k: -len(own[k])), np.int64)
    for a in range(0, len(order), AT_ONCE):
        part = order[a : a + AT_ONCE]
        width = len(own[part[0]])
        block = np.full((len(part), width), -1, np.int16)
        for row, k in enumerate(part):
            block[row, : len(own[k])] = np.frombuffer(own[k], np.uint8)
        yield part, block, np.array([len(own[k]) for k in part])


class Model:
    def __init__(self, languages: list[str], trie: Trie, p: np.ndarray):
        self.languages, self.trie = languages, trie
        self.learn(p)

    def learn(self, p: np.ndarray) -> None:
        self.p = np.maximum(p, FLOOR)
        self.scaled = self.p * BYTE ** self.trie.bytes[:, None].astype(float)

    def forward(self, block: np.ndarray, sizes: np.ndarray, keep: list | None = None) -> np.ndarray:
        alpha = np.zeros((block.shape[1] + 1, len(block), self.p.shape[1]))
        alpha[0] = 1
        for start, size, rows, piece in self.trie.matches(block, sizes):
            alpha[start + size, rows] += alpha[start, rows] * self.scaled[piece]
            if keep is not None:
                keep.append((start, size, rows, piece))
        return alpha

    def log_probabilities(self, own: list[bytes]) -> np.ndarray:
        out = np.zeros((len(own), self.p.shape[1]))
        for part, block, sizes in _blocks(own):
            alpha = self.forward(block, sizes)
            out[part] = np.log(alpha[sizes, np.arange(len(part))]) - np.log(BYTE) * sizes[:, None]
        return out

    def expected(self, own: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in each language, over all segmentations of the words."""
        out = np.zeros_like(self.p)
        for part, block, sizes in _blocks(own):
            steps: list = []
            alpha = self.forward(block, sizes, steps)
            at = np.arange(len(part))
            beta = np.zeros_like(alpha)
            beta[sizes, at] = counts[part] / alpha[sizes, at]
            for start, size, rows, piece in reversed(steps):
                flow = self.scaled[piece] * beta[start + size, rows]
                beta[start, rows] += flow
                flow *= alpha[start, rows]
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(piece, flow[:, k], minlength=len(out))
        return out


def vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def fit(samples: list[tuple[str, str]], path: str = VOCABULARY) -> Model:
    """From (text, language) pairs."""
    trie = Trie(vocabulary(path))
    languages = sorted({lang for _, lang in samples})
    by = {lang: Counter() for lang in languages}
    for text, lang in samples:
        by[lang].update(words(text))
    own = sorted(set().union(*by.values()))
    counts = np.array([[by[lang][w] for lang in languages] for w in own], float).reshape(len(own), len(languages))
    model = Model(languages, trie, np.full((trie.size, len(languages)), 1 / trie.size))
    for _ in range(ROUNDS):
        used = model.expected(own, counts)
        model.learn((used + SMOOTH) / (used.sum(0) + SMOOTH * trie.size))
    return model


def sample(labelled: DataFrame, per_language: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language, those of the least draw by a hash of id and text.

    A language's rows are counted first, and only draws below four times its share go on to be ordered: about 1,000 a language, however
    many it has. Languages whose texts are all above ``most_bytes`` give their shortest text. What the driver gets is bounded by the number of languages.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang").withColumn("_bytes", F.octet_length("text"))
    short = F.col("_bytes") <= most_bytes
    counts = stash(rows.groupBy("lang").agg(F.count_if(short).alias("_many"), F.min("_bytes").alias("_least")), "languages")
    drawn = rows.where(short).select("text", "lang", "doc_id", F.xxhash64("doc_id", "text").alias("_draw")).join(counts, "lang")
    few = drawn.where(F.pmod("_draw", F.lit(1 << 40)) / F.lit(float(1 << 40)) < 4.0 * per_language / F.col("_many"))
    order = Window.partitionBy("lang").orderBy(F.pmod("_draw", F.lit(1 << 40)), "doc_id", "text")
    out = [(r.text, r.lang) for r in few.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= per_language).select("text", "lang").collect()]
    if counts.where("_many = 0").limit(1).count():
        long = rows.join(counts.where("_many = 0"), "lang").where("_bytes = _least")
        out += [(r.text, r.lang) for r in long.groupBy("lang").agg(F.min("text").alias("text")).collect()]
    return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds ``lang_pred, score`` to the columns ``keep`` of every row: the language and its probability among those learned.

    Null text, or one without letters, is ``und`` with score 0; so is everything if nothing was learned.
    """
    uri = new_dir(docs.sparkSession, "languages")
    put_file(uri, pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers, known = pickle.loads(map_file(uri)), {}, np.empty((0, 0))
        for batch in slices(batches, "text"):
            if len(numbers) > HELD:
                numbers, known = {}, np.empty((0, 0))
            have, flat, sizes = len(numbers), [], []
            for text in texts(batch, "text"):
                own = words(text.decode("utf-8", "replace"))
                sizes.append(len(own))
                flat += [numbers.setdefault(w, len(numbers)) for w in own]
            names, scores = ["und"] * len(sizes), np.zeros(len(sizes))
            if flat and model.languages:
                new = list(numbers)[have:]
                more = model.log_probabilities(new)
                known = np.concatenate([known, more]) if have else more
                sizes = np.array(sizes)
                full = np.flatnonzero(sizes)
                total = np.add.reduceat(known[flat], (np.cumsum(sizes) - sizes)[full], axis=0)
                best = total.argmax(1)
                scores[full] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for row, k in zip(full.tolist(), best.tolist()):
                    names[row] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    need = docs.select(*dict.fromkeys([*keep, "text"]))
    return mapped(need, run, T.StructType([*(need.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify_languages(docs: DataFrame, keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """Learns from rows (doc_id, text, lang) that are not held out, and predicts all rows; see ``predict``.

    Rows that repeat are predicted alike, and each may be learned from. Of languages that are equally likely the first by code point is named. Texts
    are read whole, whatever their length; words are scored in parts of ``WORD_BYTES``. An empty table gives an empty
    result. Input columns named ``lang_pred`` or ``score`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    model = fit(sample(docs.where(~held_out(F.col("doc_id")))), path)
    return predict(docs, model, docs.columns if keep is None else keep)


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_languages(docs.withColumn("held_out", held_out(F.col("doc_id"))), ["doc_id", "held_out"])
