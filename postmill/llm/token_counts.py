"""Token counts by public tokenizers: Arrow functions encode batches of about equal bytes and return lengths only.

A long text is cut only where no token can lie across the cut, so the parts' counts add up to the whole text's. For a
sentencepiece BPE model that is any place between two characters which no piece of the vocabulary holds side by side:
merges join neighbours into pieces, so none crosses it. A part that isn't the first is encoded behind a newline, which no
piece holds either, so it gets no space of its own in front. For a tokenizers file it is a space between two ASCII letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, slices, table

#: Characters of a text's parts, and bytes of the parts that are encoded together.
PART_CHARS, BATCH_BYTES = 1 << 16, 1 << 18
#: What sentencepiece writes for a space.
SPACE = "▁"


class Pieces:
    """A sentencepiece BPE model that leaves characters as they are."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pairs, lone = set(), True
        for k in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(k)
            self.pairs.update(zip(piece, piece[1:]))
            lone &= "\n" not in piece
        self.lead = "\n"
        self.before = len(self.model.encode(self.lead))
        odd = "Aﬁ  İ \t\r\n B "  # a model that rewrites characters has other neighbours than the text
        self.whole = not lone or self.model.normalize(odd) != (SPACE + odd).replace(" ", SPACE)

    def cut(self, text: str, at: int) -> int:
        """The first safe place from ``at`` on."""
        if self.whole:
            return len(text)
        for start in range(at - 1, len(text) - 1, 256):
            shown = text[start : start + 257].replace(" ", SPACE)
            for k, pair in enumerate(zip(shown, shown[1:])):
                if pair not in self.pairs:
                    return start + k + 1
        return len(text)

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(parts, num_threads=1)]


class Words:
    """A file of the tokenizers library."""

    lead, before, letters = "", 0, re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(data)
        self.model.no_truncation()
        self.model.no_padding()

    def cut(self, text: str, at: int) -> int:
        found = self.letters.search(text, at)
        return found.start() if found else len(text)

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(parts, add_special_tokens=False)]


def _parts(text: str, limit: int, cut: Callable[[str, int], int]) -> Iterator[str]:
    start = 0
    while len(text) - start > limit:
        stop = cut(text, start + limit)
        yield text[start:stop]
        start = stop
    yield text[start:]


def lengths(texts: Iterator[str], model: Pieces | Words, part_chars: int = PART_CHARS, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text; no more than about ``batch_bytes`` of parts are encoded at a time."""
    out, parts, owner, held = [], [], [], 0

    def flush() -> None:
        for k, n in zip(owner, model.lengths(parts)):
            out[k] += n
        parts.clear()
        owner.clear()

    for k, text in enumerate(texts):
        out.append(0)
        for j, part in enumerate(_parts(text, part_chars, model.cut) if text else ()):
            if j:
                part, out[k] = model.lead + part, out[k] - model.before
            parts.append(part)
            owner.append(k)
            held += len(part.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    if parts:
        flush()
    return np.array(out, np.int64)


ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def count_tokens(docs: DataFrame, file: str, keep: list[str] | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """Adds ``n_bytes, n_tokens`` to each row of ``docs`` (text, ...), by the tokenizer in ``file``.

    ``file`` is a sentencepiece BPE ``.model`` or a ``.json`` of tokenizers; it is read on the driver and sent with the tasks, as the vocabulary's
    size doesn't grow with the data. No begin, end or added special tokens, no truncation, no padding; special strings in a text are
    handled as the library does by default. A null or empty text has no bytes and no tokens; repeated rows count alike; an empty
    table gives no rows. Texts are counted whole: one without any safe place, such as a run of one letter, is encoded in one piece, with
    memory in proportion to it. ``keep`` names the input columns to return (default all); those with the names of added ones are replaced.
    """
    with open(file, "rb") as f:
        data = f.read()
    kind = Words if file.endswith(".json") else Pieces
    plain = docs.drop(*ADDED.names)
    keep = plain.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kind(data)
        for batch in slices(batches, "text"):
            own = batch.column("text")
            n = lengths((x or "" for x in own.to_pylist()), model, part_chars)
            sizes = pc.fill_null(pc.binary_length(own), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes, pa.array(n)], names=[*keep, *ADDED.names])

    need = plain.select(*dict.fromkeys([*keep, "text"]))
    return mapped(need, run, T.StructType([need.schema[c] for c in keep] + ADDED.fields))


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
