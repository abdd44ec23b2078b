"""Fuzzy skill matching: distinct pairs are decided once, natively where that is enough, and joined back."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lists, text

RATIO = 0.9


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() >= RATIO for x, y in zip(a, b)], dtype=bool)


def _plainly_same(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    inside = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return (a == b) | subset | inside


def _could_be_alike(a: Column, b: Column) -> Column:
    """A ratio of 0.9 bounds the lengths' difference: twice the shorter is at least 0.9 of both."""
    return 2 * F.least(F.length(a), F.length(b)) >= RATIO * (F.length(a) + F.length(b))


def _signs(skill: Column) -> Column:
    """The characters of a skill, each with its turn: sets of them overlap as bags of characters do."""
    chars = F.array_sort(F.filter(F.split(skill, ""), lambda x: x != ""))
    return F.transform(chars, lambda x, k: F.concat(x, (k - F.array_position(chars, x) + 1).cast("string")))


def _grams(skill: Column, n: int = 4) -> Column:
    length = F.length(skill)
    return F.when(length >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(length - (n - 1), F.lit(1))), lambda k: F.substring(skill, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _rarest(rows: DataFrame, other: DataFrame, part, n: Column) -> DataFrame:
    """``skill, key``: of each skill the ``n`` parts that the fewest skills of the other side hold."""
    many = other.select(F.explode(part(F.col("skill"))).alias("key")).groupBy("key").agg(F.count("*").alias("many"))
    parts = rows.select("skill", n.alias("n"), F.explode(part(F.col("skill"))).alias("key")).join(many, "key", "left")
    ordered = parts.groupBy("skill", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "key"))).alias("all"))
    return ordered.select("skill", F.explode(F.slice("all", 1, F.greatest("n", F.lit(1)))).alias("x")).select("skill", "x.key")


def alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b``: all pairs of a skill of ``left`` and one of ``right`` (``skill``: canonical, distinct) that are the same: equal, one's words
    among the other's, one within the other from four characters on, or of a ratio of 0.9.

    No list meets every skill. One's words are among the other's only if its rarest word is; one is within the other only if its rarest run of four characters is. A ratio of
    0.9 needs 0.45 of both lengths as common characters, counted as bags, so of ``n`` characters the rarest ``n - need + 1`` hold a common one, and the shorter has at least 9 of 11
    of the longer's characters; pairs that meet so are held to the bags' bound before the ratio itself is found.
    """
    flip = lambda pairs: pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))

    def whole(x: DataFrame, y: DataFrame, part, held) -> DataFrame:
        keys = _rarest(x, y, part, F.lit(1)).withColumnRenamed("skill", "a")
        return keys.join(y.select(F.col("skill").alias("b"), F.explode(part(F.col("skill"))).alias("key")), "key").where(held(F.col("a"), F.col("b"))).select("a", "b")

    word = lambda x: F.array_distinct(F.split(x, " "))
    among, within = lambda a, b: F.size(F.array_except(word(a), word(b))) == 0, lambda a, b: F.contains(b, a)
    plain = left.join(right, "skill").select(F.col("skill").alias("a"), F.col("skill").alias("b"))
    for part, held in ((word, among), (_grams, within)):
        plain = plain.unionByName(whole(left, right, part, held)).unionByName(flip(whole(right, left, part, held)))
    n = F.length("skill")
    first = n - F.ceil(0.45 * (n + F.ceil(9 * n / 11))).cast("int") + 1
    x, y = (_rarest(own, left.unionByName(right), _signs, first) for own in (left, right))
    met = x.withColumnRenamed("skill", "a").join(y.withColumnRenamed("skill", "b"), "key").where(_could_be_alike(F.col("a"), F.col("b"))).select("a", "b").distinct()
    common = F.size(F.array_intersect(_signs(F.col("a")), _signs(F.col("b"))))
    near = met.where(2 * common >= RATIO * (F.length("a") + F.length("b"))).where(_alike("a", "b"))
    return plain.unionByName(near).distinct()


def supports(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """``skill, own``: each of the wanted skills (``skill``: canonical, distinct) with those of ``own`` that are the same or imply it."""
    implied = F.create_map(*[x for k, v in lists.SKILL_IMPLIED_BY.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    ways = wanted.select("skill", F.explode(F.array_distinct(F.concat(F.array("skill"), F.coalesce(F.try_element_at(implied, F.col("skill")), F.array().cast("array<string>"))))).alias("a"))
    pairs = alike(ways.select(F.col("a").alias("skill")).distinct(), own)
    return ways.join(pairs, "a").select("skill", F.col("b").alias("own")).distinct()


def supported(job_skills: DataFrame, profile_skills: list[str]) -> DataFrame:
    """``skill`` (canonical, distinct) to ``skill, supported``: whether a profile with these skills has it, or one that implies it."""
    own = sorted({_canonical(s) for s in profile_skills if s and _canonical(s)})
    implied = F.create_map(*[x for k, v in lists.SKILL_IMPLIED_BY.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    wanted = F.concat(F.array("skill"), F.coalesce(F.try_element_at(implied, F.col("skill")), F.array().cast("array<string>")))
    pairs = job_skills.select("skill", F.explode(wanted).alias("a")).select("skill", "a", F.explode(F.array(*[F.lit(s) for s in own]).cast("array<string>")).alias("b"))
    plain = pairs.withColumn("_plain", _plainly_same(F.col("a"), F.col("b")))
    open_pairs = plain.where(~F.col("_plain") & _could_be_alike(F.col("a"), F.col("b"))).select("a", "b").distinct().withColumn("_alike", _alike("a", "b"))
    decided = plain.join(open_pairs, ["a", "b"], "left").withColumn("_same", F.col("_plain") | F.coalesce("_alike", F.lit(False)))
    hit = decided.groupBy("skill").agg(F.bool_or("_same").alias("supported"))
    return job_skills.join(hit, "skill", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def same(a: str, b: str) -> bool:
    x, y = set(a.split(" ")), set(b.split(" "))
    return x <= y or y <= x or (len(a) >= 4 and len(b) >= 4 and (a in b or b in a)) or (2 * min(len(a), len(b)) >= RATIO * (len(a) + len(b)) and SequenceMatcher(None, a, b).ratio() >= RATIO)


def backed(canonical: Column, own: list[str]) -> Column:
    """Of an array of canonical skills, which a profile with a fixed list of skills has, itself or by one that implies it. No join: each distinct skill of a task is decided once."""
    mine = sorted({_canonical(s) for s in own if s and _canonical(s)})

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def decided(column: pa.Array) -> pa.Array:
        known: dict[str, bool] = {}
        for skill in pc.unique(pc.list_flatten(column)).to_pylist():
            known[skill] = any(same(way, b) for way in [skill, *lists.SKILL_IMPLIED_BY.get(skill, [])] for b in mine)
        return pa.array([[known[x] for x in row] for row in column.to_pylist()], pa.list_(pa.bool_()))

    return decided(canonical)


def _canonical(skill: str) -> str:
    s = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9+#./ -]", " ", skill.strip().lower())).strip()
    if s in lists.SKILL_ALIASES:
        return lists.SKILL_ALIASES[s]
    if len(s) > 4 and s.endswith("s") and not s.endswith("ss") and s[:-1] in lists.SKILL_ALIASES:
        return lists.SKILL_ALIASES[s[:-1]]
    return s


def mention_names(skills: list[str]) -> dict[str, list[str]]:
    """For each skill, in order and once, its names; those of fewer than three signs are left out."""
    names: dict[str, set[str]] = {}
    for alias, canonical in lists.SKILL_ALIASES.items():
        names.setdefault(canonical, set()).add(alias)
    out, seen = {}, set()
    for raw in skills:
        canonical = _canonical(raw)
        if canonical and canonical not in seen:
            own = sorted(n for n in {raw.strip().casefold(), canonical, *names.get(canonical, ())} if len(re.sub(r"[^a-z0-9+#]", "", n)) >= 3)
            if own:
                seen.add(canonical)
                out[raw.strip()] = own
    return out


def mention_patterns(skills: list[str]) -> dict[str, str]:
    """The names of each skill as a pattern of whole words."""
    return {raw: rf"(?<![a-z0-9])(?:{text.one_of(own)})(?![a-z0-9])" for raw, own in mention_names(skills).items()}


def mentioned(body: Column, skills: list[str]) -> Column:
    """The skills of a fixed list that a text names, 20 at most."""
    hay = F.lower(text.empty(body))
    found = [F.when(F.regexp_like(hay, F.lit(p)), F.lit(s)) for s, p in mention_patterns(skills).items()]
    return F.slice(F.array_compact(F.array(*found).cast("array<string>")), 1, 20)


def overlap(postings: DataFrame, profile_skills: list[str], skills: str = "skills", key: str = "job_id") -> DataFrame:
    """``key, matched, gaps``: a posting's skills that the profile supports, and the others, in their own words and order, each canonical skill once."""
    named = postings.select(key, F.posexplode(skills).alias("_at", "raw")).withColumn("skill", text.canonical_skill(F.col("raw"))).where("skill <> ''")
    firsts = named.groupBy(key, "skill").agg(F.min_by(F.trim("raw"), "_at").alias("raw"), F.min("_at").alias("_at"))
    decided = firsts.join(supported(named.select("skill").distinct(), profile_skills), "skill")
    listed = decided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "raw", "supported"))).alias("_all"))
    pick = lambda yes: F.transform(F.filter("_all", lambda x: x["supported"] == yes), lambda x: x["raw"])
    return listed.select(key, pick(True).alias("matched"), pick(False).alias("gaps"))
