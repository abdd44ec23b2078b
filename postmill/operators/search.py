"""Search: keyword scores, vector scores, their blend, orders, pages, totals and facets."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .provenance import authority

K1, B = 1.2, 0.75
#: Fixed value: the rows that pages reach.
MOST_ROWS = 10_000
WORDS = r"[^\p{L}\p{N}_]+"
FACETS = ["source", "remote_mode", "visa_sponsorship", "company_size_bucket", "employer_type", "security_clearance", "category", "employment_type"]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def _is(word: str):
    return lambda x: x == word


def bm25(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key, score`` of the rows that hold a word of the query.

    Each row counts its words and the query's, once: the counts are dealt out by ``key``, and both the totals and the scores
    read that one shuffle of a few numbers a row. Nothing is exploded.
    """
    words = sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})
    counts = let(tokens(F.col(text)), lambda own: F.struct(F.size(own).alias("long"), *[F.size(F.filter(own, _is(w))).alias(f"n{k}") for k, w in enumerate(words)]))
    counted = rows.select(F.col(key).alias("_key"), counts.alias("_c")).select("_key", F.col("_c.long").alias("_long"), *[F.col(f"_c.n{k}").alias(f"_n{k}") for k in range(len(words))]).repartition("_key")
    any_key = F.count(F.when(F.col("_key").isNull() | F.col("_key").isNotNull(), 1))  # names the key, so that both plans read the same columns
    totals = counted.agg(any_key.alias("_rows"), F.avg("_long").alias("_mean"), *[F.count_if(F.col(f"_n{k}") > 0).alias(f"_d{k}") for k in range(len(words))])
    scored = counted.where(" or ".join(f"_n{k} > 0" for k in range(len(words))) or "false").crossJoin(F.broadcast(totals))  # one row of totals
    score = F.lit(0.0)
    for k in range(len(words)):
        n, d = F.col(f"_n{k}"), F.col(f"_d{k}")
        idf = F.ln(1 + (F.col("_rows") - d + 0.5) / (d + 0.5))
        score = score + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("_long") / F.col("_mean")))
    return scored.select(F.col("_key").alias(key), score.alias("score"))


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a constant vector; null for null or zero vectors."""
    length = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(v, q, lambda x, y: x * y))
    own = F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.when((own > 0) & F.lit(length > 0), dot / (own * F.lit(length)))


def similarity(vector: Column, query: list[float]) -> Column:
    """1 - distance / 2, between 0 and 1; a missing distance counts as 0.5."""
    near = (1 + cosine(vector, query)) / 2
    return let(near, lambda x: F.when(x.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))  # least and greatest pass over nulls


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    scored = rows.where(F.col(vector).isNotNull()).select(key, similarity(F.col(vector), query).alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def hybrid(keyword: DataFrame, vector: DataFrame, key: str, alpha: float) -> DataFrame:
    """``key, score``: alpha of the vector leg and 1 - alpha of the keyword leg, each scaled by its least and largest score.

    A row that one leg lacks gets 0 from it; a leg whose scores are all one counts as 1. The legs are dealt out by ``key``, and their ends are read from
    that shuffle.
    """

    def scaled(leg: DataFrame, name: str) -> DataFrame:
        leg = leg.select(key, "score").repartition(key)
        ends = leg.agg(F.min("score").alias("_low"), F.max("score").alias("_high"), F.max(key).alias("_last"))  # the key is named so that both plans read the same columns
        value = F.when(F.col("_high") > F.col("_low"), (F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
        return leg.crossJoin(F.broadcast(ends)).select(key, value.alias(name))  # one row of ends

    both = scaled(keyword, "_k").join(scaled(vector, "_v"), key, "full")
    return both.select(key, (alpha * F.coalesce("_v", F.lit(0.0)) + (1 - alpha) * F.coalesce("_k", F.lit(0.0))).alias("score"))


def embedding_text(title: Column, company: Column, skills: Column, description: Column) -> Column:
    skill = F.nullif(F.array_join(skills, ", "), F.lit(""))
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(company, F.lit("")), skill, F.nullif(F.substring(description, 1, 1500), F.lit("")))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, scaled to length 1."""
    hashes = F.transform(tokens(text), lambda w: F.xxhash64(w))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(size)) == k, F.when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: (x / F.when(length > 0, length).otherwise(1.0)).cast("float"))


def profile_query(titles: list[str], interests: list[str], skills: list[str]) -> str | None:
    """Titles, interests and the first 20 skills, each once, 1500 characters at most."""
    seen: dict[str, str] = {}
    for part in [*titles, *interests, *skills[:20]]:
        if part and part.strip():
            seen.setdefault(part.strip().casefold(), part.strip())
    return " ".join(seen.values())[:1500] or None


def order(name: str, key: str = "job_id") -> list[Column]:
    c, epoch = F.col, F.lit("1970-01-01").cast("timestamp")
    orders = {
        "posted_desc": [F.coalesce(c("posted_date"), epoch).desc()], "salary_desc": [F.coalesce(c("salary_max"), F.lit(0.0)).desc()], "newest": [c("posted_date").desc_nulls_last()],
        "relevance": [c("score").desc()],
    }
    return [*orders.get(name, orders["posted_desc"]), c(key).asc()]


def page(rows: DataFrame, by: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1, of 200 rows at most, within the first 10,000 rows; only the rows up to its end are sorted."""
    if number < 1 or not 1 <= size <= 200 or number * size > MOST_ROWS:
        raise ValueError(f"pages begin at 1, have 1 to 200 rows and end within {MOST_ROWS} rows")
    return rows.orderBy(*by).limit(number * size).offset((number - 1) * size)


def facets(rows: DataFrame, columns: list[str] = FACETS) -> DataFrame:
    """``facet, value, n`` for all columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).select("p.facet", "p.value").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def collapse_reposts(rows: DataFrame, keys: list[Column], source: str = "source", position: list[Column] | None = None) -> DataFrame:
    """Keeps the most authoritative row of equal keys, the first of equals, one of those equal in that too, with ``duplicate_count``, ``also_on`` and ``first_position``. Null keys are equal.

    ``position`` gives the order of rows. Keys are 128 bits of hash, so that long ones aren't moved; they are grouped with partial aggregates before the
    shuffle and joined back, so a key of very many rows needs no window and its join can be split.
    """
    position = position or [F.col("job_id")]
    null = [k.isNull() for k in keys]
    own = ["_k0", "_k1"]
    first = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(position)])
    named = rows.withColumns({"_k0": F.xxhash64(*keys, *null), "_k1": F.xxhash64(F.lit(1), *keys, *null), "_rank": F.struct(authority(F.col(source)).alias("a"), first.alias("first"))})
    per_source = named.groupBy(*own, F.col(source).alias("_s")).agg(F.count("*").alias("_n"), F.min("_rank").alias("_best"), F.min("_rank.first").alias("_first"))
    groups = per_source.groupBy(*own).agg(
        F.min("_best").alias("_best"), F.sum("_n").alias("_many"), F.min("_first").alias("first_position"), F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_n").alias("n"))).alias("_counts")
    )
    best = groups.withColumnRenamed("_best", "_rank")
    joined = named.join(best, [*own, "_rank"]).dropDuplicates(own)  # rows that are equal in rank and position, of which any one stays
    others = F.array_sort(F.transform(F.filter("_counts", lambda x: x["s"].isNotNull() & ((x["s"] != F.col(source)) | (x["n"] > 1))), lambda x: x["s"]))
    return joined.select(*rows.columns, (F.col("_many") - 1).alias("duplicate_count"), others.alias("also_on"), "first_position")


def ladder(rows: DataFrame, age_hours: Column, rungs: list[int], target: int, key: Column | None = None) -> DataFrame:
    """``rung, total``: the first rung whose rows number ``target``, else the last. One pass; with ``key`` rows of one key count once."""
    inside = rows.where(age_hours < rungs[-1])
    if key is not None:
        inside = inside.groupBy(key.alias("_key")).agg(F.min(age_hours).alias("_age"))
        age_hours = F.col("_age")
    counts = inside.agg(*[F.count_if(age_hours < r).alias(f"_r{r}") for r in rungs])
    choice = F.coalesce(*[F.when(F.col(f"_r{r}") >= target, F.struct(F.lit(r).alias("rung"), F.col(f"_r{r}").alias("total"))) for r in rungs], F.struct(F.lit(rungs[-1]).alias("rung"), F.col(f"_r{rungs[-1]}").alias("total")))
    return counts.select(choice.alias("c")).select("c.rung", "c.total")


def resume_to_jobs(postings: DataFrame, vector: str, query: list[float], k: int, p=None, excluded: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest postings to a résumé's vector; under a profile the active ones that it may take, without those excluded, judged and in priority order."""
    from .verdict import priority_order, with_verdict

    rows = postings
    if p is not None:
        rows = rows.where(~F.col("is_active").eqNullSafe(False))
        rows = rows.where(~F.col("citizenship_required")) if p.reject_citizenship_only else rows
    near = nearest(rows, "job_id", vector, query, k)
    found = rows.join(near.withColumnRenamed("score", "similarity"), "job_id")
    if p is None:
        return found.orderBy(F.col("similarity").desc(), "job_id")
    found = found if excluded is None else found.join(excluded.select("job_id").distinct(), "job_id", "left_anti")
    return with_verdict(found, p).orderBy(*priority_order(p.prefer_cap_exempt))


def rows_of_each(rows: DataFrame, by: list[Column], top: int, *partition: str) -> DataFrame:
    """The first ``top`` rows of each group; Spark cuts the groups before the shuffle."""
    turn = F.row_number().over(Window.partitionBy(*partition).orderBy(*by))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= top).drop("_turn")
