"""Feeds of a table of profiles: every posting that any of very many profiles should be shown, in one plan.

Profiles are compiled to rows. Only pairs that can fit are made: titles meet target roles by joins on role family, on the rarest words that a fit needs,
and on runs of characters where one is within the other; ``pairs`` judges them, a block of profiles at once. Skills of both
tables meet once each, as distinct names, by the exact fuzzy join of ``skills.alike``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import automaton, lists, text
from . import pairs, skills
from .verdict import COMPILED, Profile, Wanted, _among, compiled, spread, with_facts

#: Distinct words of all profiles that a pass over the postings looks for; more profiles than those are judged in several passes.
MOST_WORDS = 1_000_000
#: Profiles of a block, about. A posting is shuffled once for each block at most, a block once for each share of the postings; so what is shuffled grows with both tables, not with their pairs.
BLOCK = 16_384
#: Postings that are Python values at once.
JOBS = 1_000


def compile_table(profiles: DataFrame) -> DataFrame:
    """Profiles (``schemas.PROFILE``; missing and null values are the defaults of ``Profile``) as rows of their rules."""
    names = [c for c in profiles.columns if c in Profile.__dataclass_fields__]
    schema = profiles.sparkSession.createDataFrame([], COMPILED).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compiled(Profile(**{k: [x for x in v if x is not None] if isinstance(v, list) else v for k, v in r.items() if v is not None})) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return profiles.select(*names).mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    if kind.typeName() == "array":
        return pa.list_(_arrow(kind.elementType))
    if kind.typeName() == "struct":
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "boolean": pa.bool_(), "integer": pa.int32()}[kind.typeName()]


def _wanted(rows: DataFrame) -> Wanted:
    """The words that these profiles look for, once each."""
    kinds = {"interests": F.col("interests.name"), "words": F.flatten("interests.words"), "names": F.flatten("mentions.names")}
    every = F.explode(F.concat(*[F.transform(words, _kind(kind)) for kind, words in kinds.items()])).alias("x")
    got = rows.select(every).distinct().limit(MOST_WORDS + 1).collect()
    if len(got) > MOST_WORDS:
        raise ValueError(f"these profiles look for over {MOST_WORDS} distinct words: judge them in parts")
    return Wanted(**{kind: {r.x.w for r in got if r.x.kind == kind} for kind in kinds})


def _kind(kind: str):
    return lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w"))


def _runs(value: Column) -> Column:
    """All runs of one to four characters."""
    pieces = lambda k: F.array(*[F.substring(value, k, F.lit(n)) for n in range(1, 5)])
    return F.array_distinct(F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), pieces)), lambda x: x != ""))


def _tellers(value: Column) -> Column:
    """Runs of four characters, or a shorter text itself: a text that holds it holds all of them."""
    return F.when(F.length(value) < 4, F.array(value)).otherwise(skills._grams(value))


def _within(small: DataFrame, large: DataFrame) -> DataFrame:
    """``a, b``: all pairs in which a text of ``small`` is within one of ``large`` (``skill``)."""
    keys = skills._rarest(small, large, _tellers, F.lit(1)).withColumnRenamed("skill", "a")
    return keys.join(large.select(F.col("skill").alias("b"), F.explode(_runs(F.col("skill"))).alias("key")), "key").where(F.contains("b", "a")).select("a", "b")


def titles_that_fit(titles: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """``_name, target``: all pairs of a title (``_name, _words, _families``, distinct) and a target role (``target, words, families``, distinct) whose score is ``least`` or more.

    A target of n words needs ``ceil(least * n)`` of them in the title, so of its rarest ``n - need + 1`` words one at least.
    """
    names, roles = titles.where("_name <> ''").select(F.col("_name").alias("skill")), targets.select(F.col("target").alias("skill"))
    met = _within(roles, names).select(F.col("b").alias("_name"), F.col("a").alias("target")).unionByName(_within(names, roles).select(F.col("a").alias("_name"), F.col("b").alias("target")))
    if least <= 0.85:
        kinds = targets.select("target", F.explode("families").alias("f"))
        met = met.unionByName(titles.select("_name", F.explode("_families").alias("f")).join(kinds, "f").select("_name", "target"))
    held = titles.select("_name", "_words", F.explode(F.array_distinct("_words")).alias("w"))
    many = held.groupBy("w").agg(F.count("*").alias("many"))
    need = F.ceil(F.size("words") * F.lit(least) - 1e-9)
    first = targets.select("target", "words", F.explode("words").alias("w")).join(many, "w").groupBy("target", "words").agg(F.array_sort(F.collect_list(F.struct("many", "w"))).alias("all"))
    # words that no title holds are the rarest of all: they use up the places of a prefix first
    keys = first.select("target", "words", F.explode(F.expr(f"slice(all, 1, greatest(0, size(words) - cast(ceil(size(words) * {least}D - 1e-9D) AS int) + 1 - (size(words) - size(all))))")).alias("x")).select("target", "words", "x.w")
    worded = held.join(keys, "w").where(F.size(F.array_intersect("words", "_words")) >= need).select("_name", "target")
    return met.unionByName(worded).distinct()


def _blocks(ready: DataFrame) -> DataFrame:
    """``_block, _profiles``: the profiles of each block, pickled for the tasks that judge postings under them."""

    def run(rows: pa.Table) -> pa.Table:
        packed = pickle.dumps(pairs.Block(rows.drop_columns("_block").to_pylist()))
        return pa.table({"_block": rows["_block"][:1].cast(pa.int64()), "_profiles": pa.array([packed], pa.binary())})

    return ready.groupBy("_block").applyInArrow(run, "_block long, _profiles binary")


def _judged(met: DataFrame, texts: bool) -> DataFrame:
    """The verdicts of rows that are dealt by ``_key``: in each key's rows a block of profiles comes first and is held, postings follow and are judged some at a time."""
    many = T.ArrayType(T.StringType()) if texts else T.IntegerType()
    kinds = {"profile_id": T.StringType(), "job_id": met.schema["job_id"].dataType, "verdict": T.StringType(), "score": T.DoubleType(), "reasons": many, "red_flags": many, "matched": many, "gaps": many, "recommendable": T.BooleanType()}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items() if texts or k != "reasons"])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block = None
        for batch in batches:
            for k in range(0, batch.num_rows, JOBS):
                part = batch.slice(k, JOBS)
                keys, packed = part["_key"].to_numpy(), part["_profiles"]
                cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                for start, end in zip(cuts, [*cuts[1:], part.num_rows]):
                    if keys[start] != held:
                        held, block = keys[start], None
                    if packed[start].is_valid:
                        block, start = pickle.loads(packed[start].as_py()), start + 1
                    if block is not None and start < end:
                        yield from (pairs.as_batch(x, arrow) for x in block.judge(part.slice(start, end - start).drop_columns("_profiles").to_pylist(), texts))

    return met.mapInArrow(run, schema)


def feeds(postings: DataFrame, profiles: DataFrame, least: float = 0.75, semantic: str | None = None, limit: int | None = None, home: str | None = None, texts: bool = True) -> DataFrame:
    """``profile_id, job_id`` and the verdict of every pair of a posting and a profile with target roles whose title scores ``least`` or more and that no hard rule rejects.

    With 0.75 these hold all recommendable pairs, as a lower title blocks a recommendation. Profiles without target roles get none. Rows of equal ``job_id`` or profile ``id`` are
    judged each. Postings are scanned in full once; their titles and skills are read once more each, as distinct values. ``home``: a folder that driver and executors share, in which
    profiles and distinct names are stored first; that keeps the plan short. Without ``texts``, ``matched``, ``gaps`` and ``red_flags`` are their sizes and there are no ``reasons``.

    Pairs are made in the task that scores them and aren't shuffled: profiles are dealt into blocks, and a posting goes to the blocks with a target role that fits its title.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        if home is None:
            return df
        df.write.parquet(f"{home}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{home}/{name}")

    rows = kept(compile_table(spread(profiles)).where("has_titles"), "profiles")
    targets = rows.select(F.explode("titles").alias("t")).select(F.col("t.name").alias("target"), F.col("t.words").alias("words"), F.col("t.families").alias("families")).distinct()
    shown = postings.select("title").distinct().withColumn("_hits", automaton.first_matches((F.col("title"), {f"family:{k}": v for k, v in lists.ROLE_FAMILIES.items()})))
    titles = shown.select(F.lower(F.trim(text.empty(F.col("title")))).alias("_name"), F.expr(_among("family", list(lists.ROLE_FAMILIES))).alias("_families")).distinct().withColumn("_words", F.expr("regexp_extract_all(_name, '([a-z0-9+#]+)', 1)"))
    fits = kept(titles_that_fit(kept(titles, "titles"), kept(targets, "targets"), least), "fits")

    wanted = postings.select(F.explode("skills").alias("s")).select(text.canonical_skill(F.col("s")).alias("skill")).where("skill <> ''").distinct()
    own = rows.select("id", "skills", F.explode("skills").alias("own"))
    support = kept(skills.supports(kept(wanted, "wanted"), kept(own.select(F.col("own").alias("skill")).distinct(), "own")), "support")
    backed = own.join(support, "own").groupBy("id", "skills").agg(F.collect_set("skill").alias("_has"))
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)))
    ready = kept(dealt.join(backed, ["id", "skills"], "left").withColumn("_has", F.coalesce("_has", F.array().cast("array<string>"))), "ready")

    places = ready.select("_block", F.explode("titles.name").alias("target")).distinct()
    fitting = kept(fits.join(places, "target").groupBy("_name").agg(F.collect_set("target").alias("_targets"), F.collect_set("_block").alias("_blocks")), "fitting")
    cores = postings.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, postings.rdd.getNumPartitions())
    shares = -(-tasks // blocks)
    # texts are read of those alone whose titles fit some role
    named = spread(postings).withColumn("_name", F.lower(F.trim(text.empty(F.col("title"))))).join(fitting, "_name")
    facts = with_facts(named, _wanted(rows), limit).select("job_id", *pairs.facts(semantic), "_targets", F.explode("_blocks").alias("_block"))
    facts = facts.withColumn("_key", F.col("_block") * shares + F.pmod(F.xxhash64("job_id"), F.lit(shares)))
    copies = _blocks(ready).select("_profiles", "_block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    copies = copies.select("_profiles", "_block", (F.col("_block") * shares + F.col("_share")).alias("_key"))
    met = facts.unionByName(copies, allowMissingColumns=True).repartitionById(blocks * shares, F.col("_key").cast("int"))
    return _judged(met.sortWithinPartitions("_key", F.col("_profiles").isNull(), "_name").drop("_block"), texts)
