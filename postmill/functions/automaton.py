"""Many patterns in one pass over a text.

From each pattern the words are read of which every match must hold one. An Aho-Corasick automaton of all patterns' words runs over the lower-cased text
once; only a pattern of which a word occurs is searched for itself. So texts that say nothing, which are most, cost one pass whatever the number of patterns,
and the plan holds one function instead of a regular expression for each rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as kinds
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that a part of a pattern may stand for before it is left open.
MOST = 512
TOKEN = re.compile(r"[a-z0-9+#]+")
SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+")


def _spelled(op, arg) -> set[str] | None:
    """All strings that a part of a pattern stands for, or None."""
    if op is kinds.LITERAL:
        return {chr(arg).lower()}
    if op in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return {""}
    if op is kinds.IN and all(o is kinds.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is kinds.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is kinds.BRANCH:
        parts = [_sequence(x)[0] for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _needed(op, arg) -> set[str] | None:
    if op is kinds.SUBPATTERN:
        return _sequence(arg[3])[1]
    if op is kinds.BRANCH:
        parts = [_sequence(x)[1] for x in arg[1]]
        return set().union(*parts) if all(parts) else None
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] > 0:
        return _sequence(arg[2])[1]
    return None


def _sequence(parts) -> tuple[set[str] | None, set[str] | None]:
    """Of parts in a row: all strings they stand for, if those are few; and the best set of words of which a match holds one."""
    found, run, whole = [], {""}, True
    for op, arg in parts:
        own = _spelled(op, arg)
        if own is not None and len(run) * len(own) <= MOST:
            run = {a + b for a in run for b in own}
            continue
        whole = False
        found += [run, own if own is not None else _needed(op, arg)]
        run = {""}
    found.append(run)
    return (run if whole else None), max((x for x in found if x and "" not in x), key=lambda x: min(map(len, x)), default=None)


def words_of(pattern: str) -> set[str]:
    """Lower-cased words of which every match of the pattern holds one."""
    found = _sequence(parser.parse(pattern, re.I))[1]
    if not found:
        raise ValueError(f"a match of this pattern needs no word: {pattern}")
    return found


class Scanner:
    """Named patterns, without regard to case."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.patterns, self.words = {}, ahocorasick.Automaton()
        owners: dict[str, list[str]] = {}
        for name, pattern in rules:
            self.patterns[name] = re.compile(pattern, re.I)
            for word in words_of(pattern):
                owners.setdefault(word, []).append(name)
        for word, names in owners.items():
            self.words.add_word(word, names)
        if owners:
            self.words.make_automaton()

    def likely(self, text: str) -> set[str]:
        """The patterns of which a word occurs."""
        return set().union(*(names for _, names in self.words.iter(text.lower()))) if self.patterns else set()

    def hits(self, text: str | None) -> dict[str, str]:
        """The first match of each pattern that matches."""
        likely = self.likely(text) if text else ()
        return {name: m[0] for name, p in self.patterns.items() if name in likely and (m := p.search(text))}


class Vocabulary:
    """Words to be found in texts: anywhere, or as ``edged`` not within a longer run of letters and digits."""

    def __init__(self, words: Iterable[str], edged: bool):
        self.edged, self.words = edged, ahocorasick.Automaton()
        for word in words:
            self.words.add_word(word, word)
        if len(self.words):
            self.words.make_automaton()

    def hits(self, text: str) -> set[str]:
        if not len(self.words):
            return set()
        edge = lambda k: not 0 <= k < len(text) or not (text[k].isascii() and text[k].isalnum())
        return {w for k, w in self.words.iter(text) if not self.edged or (edge(k - len(w)) and edge(k + 1))}


@lru_cache(32)
def scanner(rules: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(rules)


@lru_cache(8)
def vocabulary(words: tuple[str, ...], edged: bool) -> Vocabulary:
    return Vocabulary(words, edged)


def first_matches(*fields: tuple[Column, dict[str, str]]) -> Column:
    """Of texts and the named patterns for each: a map from the names of those that match to their first match. Nulls match nothing."""
    rules = [tuple(own.items()) for _, own in fields]

    @F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
    def found(*columns: pa.Array) -> pa.Array:
        out: list[dict] = [{} for _ in columns[0]]
        for own, column in zip(rules, columns):
            scan, seen = scanner(own), {}
            for k, text in enumerate(column.to_pylist()):
                if text:
                    if (hit := seen.get(text)) is None:
                        hit = scan.hits(text)
                        if len(text) < 200:  # titles and places repeat
                            seen[text] = hit
                    out[k].update(hit)
        return pa.array([list(x.items()) for x in out], pa.map_(pa.string(), pa.string()))

    return found(*(c for c, _ in fields))


def matching_sentences(text: Column, rules: dict[str, str]) -> Column:
    """The sentences of a text in which a pattern matches, with the names of those that do."""
    own = tuple(rules.items())

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType()))])))
    def found(column: pa.Array) -> pa.Array:
        scan, out = scanner(own), []
        for text in column.to_pylist():
            parts = SENTENCE.split(text) if text and scan.likely(text) else []
            out.append([{"s": s, "rules": list(hit)} for s in parts if (hit := scan.hits(s))])
        return pa.array(out, pa.list_(pa.struct([("s", pa.string()), ("rules", pa.list_(pa.string()))])))

    return found(text)


def mentions(text: Column, words: Iterable[str], edged: bool = False) -> Column:
    """The words of a fixed list that a lower-cased text holds, in order."""
    own = tuple(sorted(words))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(column: pa.Array) -> pa.Array:
        seen = vocabulary(own, edged)
        return pa.array([sorted(seen.hits(t or "")) for t in column.to_pylist()], pa.list_(pa.string()))

    return found(text)


def tokens_among(text: Column, words: Iterable[str]) -> Column:
    """The words of a fixed list that are tokens of a lower-cased text, in order."""
    own = frozenset(words)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(column: pa.Array) -> pa.Array:
        return pa.array([sorted(own.intersection(TOKEN.findall(t or ""))) for t in column.to_pylist()], pa.list_(pa.string()))

    return found(text)
