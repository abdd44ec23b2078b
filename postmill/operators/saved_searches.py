"""Saved searches as rows: very many of them are counted at once, and no plan grows with their number.

Postings are first counted by signature: what their filter columns hold, which flags they pass, and between which of the searches' moments they were posted and ingested.
Searches that differ in nothing but what they ask of the time of ingestion are one kind. Signatures are dealt into chunks, kinds into parts, and each chunk meets each part once: there a
filter is a bit for each signature, a kind the conjunction of its filters' bits, and with signatures in order of ingestion all its searches are counted from one running sum of bits.
So no row is made for a pair of a search and a signature that it matches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from . import filters
from .filters import BANDS, MULTI, Filters

#: Filters that a posting passes or not, whatever the search.
FLAGS = ["include_active", "exclude_citizenship", "exclude_recruiter", "direct_sources_only", "exclude_no_sponsorship", "exclude_ghost", "true_entry_only", "new_grad_only"]
#: Rows of searches: the fields of ``Filters`` with an id and the moment at which the search was last looked at.
SEARCH = {
    "search_id": "string", "any_of": "map<string, array<string>>", **dict.fromkeys(FLAGS, "boolean"), "cap_exempt": "array<string>", "known_h1b": "boolean", "known_everify": "boolean",
    "ingested_after": "timestamp", "experience": "array<string>", "date_preset": "string", "date_from": "date", "date_to": "date", "last_seen": "timestamp",
}
#: Columns of postings that filters read; those that a table lacks count as null.
READ = {
    **dict.fromkeys([*MULTI, "seniority", "cap_exempt"], "string"), **dict.fromkeys(["is_active", "citizenship_required", "is_recruiter_post", "new_grad_program", "known_h1b_sponsor", "known_everify"], "boolean"),
    "yoe_min": "double", "posted_date": "timestamp", "ingested_at": "timestamp",
}
#: Distinct moments of all searches, which the driver sorts (8 bytes each); more searches than have those are counted in parts.
MOST_MOMENTS = 1_000_000
#: Signatures that a chunk holds about, searches whose kinds make a part, and filters of which a task keeps the bits.
CHUNK, PART, MOST_KEPT = 500_000, 1_000_000, 1_000


def _bits(tests: list[Column]) -> Column:
    return reduce(Column.__add__, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)])


def _filled(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def compile_searches(searches: DataFrame, as_of: datetime) -> DataFrame:
    """Searches (``SEARCH``; missing columns and nulls ask for nothing) as rows of rules. A filter of an unknown column is an error, an unknown band or preset asks for nothing."""
    rows = _filled(searches, SEARCH)
    wanted = F.map_filter("any_of", lambda _, v: F.coalesce(F.size(F.filter(v, lambda x: x != "")) > 0, F.lit(False)))
    unknown = F.array_except(F.map_keys("any_of"), F.array(*map(F.lit, MULTI)))
    wanted = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("no such filter: "), F.array_join(unknown, ", ")))).otherwise(wanted)
    micros = lambda c: F.unix_micros(c)
    hours = F.create_map(*[F.lit(x) for kv in dates.PRESETS.items() for x in kv])[F.col("date_preset")]
    now = micros(dates.moment(as_of))
    caps = F.filter(F.coalesce("cap_exempt", F.array().cast("array<string>")), lambda x: x.isNotNull())
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn("_any", wanted).select(
        "search_id", "_any", *[F.filter(F.col("_any")[c], lambda x: x != "").alias(f"_in_{c}") for c in MULTI], _bits([yes(f) for f in FLAGS]).alias("_need"),
        _bits([F.coalesce(F.array_contains("experience", b), F.lit(False)) for b in BANDS]).alias("_bands"), caps.alias("_caps"), _bits([yes("known_h1b"), yes("known_everify")]).alias("_sponsor"),
        F.when(hours.isNotNull(), now - hours * F.lit(3_600_000_000) + 1).otherwise(micros(F.col("date_from").cast("timestamp"))).alias("_posted_from"),
        F.when(hours.isNull(), micros(F.date_add("date_to", 1).cast("timestamp"))).alias("_posted_to"),
        (micros("ingested_after") + 1).alias("_ingested_from"), (micros("last_seen") + 1).alias("_new_from"),
    )


def _moments(rules: DataFrame, *columns: str) -> list[float]:
    got = rules.select(F.explode(F.array(*columns)).alias("m")).where("m IS NOT NULL").distinct().limit(MOST_MOMENTS + 1).collect()
    if len(got) > MOST_MOMENTS:
        raise ValueError(f"these searches name over {MOST_MOMENTS} moments: count them in parts")
    return [float("-inf"), *sorted({0.0, *(float(r.m) for r in got)}), float("inf")]


def _ranked(rows: DataFrame, moments: list[float], *columns: str) -> DataFrame:
    """The columns as the number of moments that aren't after them; null stays null. Microseconds are exact as doubles until the year 2255."""
    for c in columns:
        placed = Bucketizer(splits=moments, inputCol="_x", outputCol="_rank").transform(rows.withColumn("_x", F.coalesce(F.col(c), F.lit(0)).cast("double")))
        rows = placed.withColumn(c, F.when(F.col(c).isNotNull(), F.col("_rank").cast("int"))).drop("_x", "_rank")
    return rows


def signatures(postings: DataFrame, as_of: datetime, posted: list[float], ingested: list[float]) -> DataFrame:
    """Postings counted (``n``) by all that searches can tell of them."""
    rows = _filled(postings, READ)
    passes = lambda **one: F.coalesce(filters.build(Filters(**one), as_of), F.lit(False))
    rows = rows.select(
        *MULTI, F.col("cap_exempt").alias("_cap"), _bits([passes(**{f: True}) for f in FLAGS]).alias("_flags"), _bits([passes(experience=[b]) for b in BANDS]).alias("_in_bands"),
        _bits([passes(known_h1b=True), passes(known_everify=True)]).alias("_sponsored"), F.unix_micros("posted_date").alias("_posted"), F.unix_micros("ingested_at").alias("_ingested"),
    )
    rows = _ranked(_ranked(rows, posted, "_posted"), ingested, "_ingested")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def _packed(held: np.ndarray) -> np.ndarray:
    """A bit for each of the signatures, in words of 64, with one word of none at the end."""
    bits = np.zeros((len(held) // 64 + 1) * 8, np.uint8)
    own = np.packbits(held, bitorder="little")
    bits[: len(own)] = own
    return bits.view(np.uint64)


def _filters(kind: dict) -> list[tuple]:
    """The filters of a kind, each as the key under which its bits are kept."""
    out = [("in", c, tuple(kind[f"_in_{c}"])) for c in MULTI if f"_in_{c}" in kind]
    out += [("flag", 1 << k) for k in range(len(FLAGS)) if kind["_need"] >> k & 1]
    if kind["_bands"]:
        out.append(("bands", kind["_bands"]))
    if kind["_caps"] or kind["_sponsor"]:
        out.append(("sponsor", tuple(kind["_caps"]), kind["_sponsor"]))
    if "_posted_from" in kind or "_posted_to" in kind:
        out.append(("posted", kind.get("_posted_from", 0), kind.get("_posted_to", math.inf)))
    return out


def _bits_of(told: pa.Table) -> Callable[[tuple], np.ndarray]:
    """Gives a filter's bits over the signatures; those of the filters asked for last are kept."""
    number = {c: told.column(c).fill_null(-1).to_numpy() for c in ("_flags", "_in_bands", "_sponsored", "_posted")}
    among = lambda c, values: pc.is_in(told.column(c), pa.array(values, pa.string())).to_numpy(zero_copy_only=False)
    kept: dict[tuple, np.ndarray] = {}

    def held(kind: str, *of) -> np.ndarray:
        if kind == "in":
            return among(*of)
        if kind == "sponsor":
            return among("_cap", of[0]) | (number["_sponsored"] & of[1] != 0)
        if kind == "posted":
            return (number["_posted"] >= of[0]) & (number["_posted"] < of[1])
        return number["_flags" if kind == "flag" else "_in_bands"] & of[0] != 0

    def bits(name: tuple) -> np.ndarray:
        if name not in kept:
            if len(kept) >= MOST_KEPT:
                kept.clear()
            kept[name] = _packed(held(*name))
        return kept[name]

    return bits


def _met(told: pa.Table, asked: pa.Table) -> pa.Table:
    """Of each kind (``_kind``, with the moments ``since`` of its searches) how many postings of these signatures were ingested at or after each of them; all for -1."""
    told = told.set_column(told.schema.get_field_index("_ingested"), "_ingested", told.column("_ingested").fill_null(-1)).sort_by("_ingested")
    ingested, n, bits = told.column("_ingested").to_numpy(), told.column("n").to_numpy(), _bits_of(told)
    planes = [(1 << k, _packed(n >> k & 1 == 1)) for k in range(int(n.max(initial=0)).bit_length())]
    planes = [(weight, plane) for weight, plane in planes if plane.any()]
    many = []
    for kind, since in zip(asked.column("_kind"), asked.column("since")):
        at = np.searchsorted(ingested, since.values.to_numpy())
        word, before, found = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1), np.zeros(len(at), np.int64)
        own = [bits(name) for name in _filters(json.loads(kind.as_py()))]
        for weight, plane in planes:
            both = reduce(np.bitwise_and, own, plane)
            ends = np.cumsum(np.bitwise_count(both), dtype=np.int64)
            found += weight * (ends[-1] - ends[word] + np.bitwise_count(both[word]) - np.bitwise_count(both[word] & before))
        many.append(found)
    return pa.table({"_kind": asked.column("_kind"), "since": asked.column("since").cast(pa.list_(pa.int32())), "many": pa.array(many, pa.list_(pa.int64()))})


def counts(postings: DataFrame, searches: DataFrame, as_of: datetime) -> DataFrame:
    """``search_id, total, new_count`` of every search (``SEARCH``), as ``records.saved_counts`` gives them; ids are distinct.

    New are postings ingested after the search was last seen, all if it never was. Postings are scanned once, and counted. Equal to building each search's filter (tests).
    """
    rules = compile_searches(searches, as_of)
    posted, ingested = _moments(rules, "_posted_from", "_posted_to"), _moments(rules, "_ingested_from", "_new_from")
    rules = _ranked(_ranked(rules, posted, "_posted_from", "_posted_to"), ingested, "_ingested_from", "_new_from")
    lists = [*[f"_in_{c}" for c in MULTI], "_caps"]
    rules = rules.withColumns({c: F.sort_array(F.array_distinct(c)) for c in lists})  # columns of their own: to_json forgets the names of arrays that array_sort gives
    kind = F.to_json(F.struct(*lists, "_need", "_bands", "_sponsor", "_posted_from", "_posted_to"))
    since, fresh = F.coalesce("_ingested_from", F.lit(-1)), F.coalesce("_new_from", F.lit(-1))
    wanted = rules.select("search_id", kind.alias("_kind"), F.explode(F.array(F.struct(F.lit(False).alias("new"), since.alias("since")), F.struct(F.lit(True).alias("new"), F.greatest(since, fresh).alias("since")))).alias("w")).select("search_id", "_kind", "w.*")

    tasks, size = 2 * postings.sparkSession.sparkContext.defaultParallelism, lambda rows, each: math.ceil(rows.count() / each)
    chunks, parts = max(tasks, size(postings, CHUNK)), max(1, size(searches, PART))
    deal = lambda rows: rows.repartition(4 * chunks * parts, "_chunk", "_part")  # noqa: E731  more than there are pairs of the two, so that few share a task
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    told = signatures(postings, as_of, posted, ingested)
    told = told.withColumn("_chunk", F.pmod(F.xxhash64(*told.columns), F.lit(chunks)).cast("int")).withColumn("_part", each(parts))
    asked = wanted.select("_kind", "since").distinct().groupBy("_kind").agg(F.array_sort(F.collect_list("since")).alias("since"))  # as many as moments at most
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_kind"), F.lit(parts)).cast("int")).withColumn("_chunk", each(chunks))
    met = deal(told).groupBy("_chunk", "_part").cogroup(deal(asked).groupBy("_chunk", "_part")).applyInArrow(lambda t, a: _met(t, a), "_kind string, since array<int>, many array<long>")
    found = met.repartition("_kind").select("_kind", F.explode(F.arrays_zip("since", "many")).alias("x")).groupBy("_kind", "x.since").agg(F.sum("x.many").alias("many"))
    of = lambda new: F.coalesce(F.sum(F.when(F.col("new") == new, F.col("many"))), F.lit(0))
    return wanted.join(found, ["_kind", "since"], "left").groupBy("search_id").agg(of(False).alias("total"), of(True).alias("new_count"))
