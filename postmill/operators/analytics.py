"""Roll-ups: run status, funnels, statistics, usage, companies, rate limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..schemas import ENUMS

STAGES = ENUMS["pipeline"]


def latest_with_totals(rows: DataFrame, group: str, order: list[Column], total: Column, name: str = "total") -> DataFrame:
    """The latest row of each group with the group's total. The window keeps one row a group before the shuffle."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    latest = rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    return latest.join(rows.groupBy(group).agg(F.sum(total).alias(name)), group)


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), 4), F.lit(0.0))


def funnel(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, a count for each stage, responded, and four rates. Unknown stages don't count."""
    n = {s: F.count_if(F.col(status) == s) for s in STAGES}
    counted = rows.where(F.col(status).isin(STAGES)).agg(F.count("*").alias("total_applications"), *[c.alias(s) for s, c in n.items()])
    c, total = F.col, F.col("total_applications")
    responded, interviewing = total - c("applied"), c("interview") + c("offer")
    return counted.select(
        "total_applications", *STAGES, responded.alias("responded"), rate(responded, total).alias("response_rate"), rate(c("oa") + interviewing, total).alias("screening_rate"),
        rate(interviewing, total).alias("interview_rate"), rate(c("offer"), total).alias("offer_rate"),
    )


def funnel_by_source(rows: DataFrame, position: list[Column], status: str = "status") -> DataFrame:
    """``source, source_kind, applications, responded, offers``; the kind is the first seen by ``position``. Sort by applications downwards, then source."""
    valid = rows.where(F.col(status).isin(STAGES)).withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")))
    return valid.groupBy("source").agg(
        F.min_by(F.coalesce("source_kind", F.lit("aggregator")), F.struct(*position)).alias("source_kind"), F.count("*").alias("applications"),
        F.count_if(F.col(status) != "applied").alias("responded"), F.count_if(F.col(status) == "offer").alias("offers"),
    )


def stats(rows: DataFrame, ts: str, as_of: datetime) -> DataFrame:
    """One row: all rows, and those after each of five cumulative moments."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(ts) > dates.back(as_of, dates.PRESETS[p])).alias(f"last_{p}") for p in ("24h", "7d", "14d", "21d", "1m")])


def usage(rows: DataFrame, since: str) -> DataFrame:
    return rows.where(F.col("period") >= since).groupBy("metric").agg(F.sum("count").alias("total"))


def user_summary(users: DataFrame, profiles: DataFrame, counters: DataFrame, today: str, week: str, month: str) -> DataFrame:
    """Users with their profiles and their usage of today, 7 and 30 days."""
    many = profiles.groupBy("user_id").agg(F.count("*").alias("profiles"))
    own = counters.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(F.col("period") >= since, F.col("count"))), F.lit(0)).alias(name) for name, since in (("used_today", today), ("used_7d", week), ("used_30d", month))])
    joined = users.join(many, users.id == many.user_id, "left").drop("user_id").join(own, users.id == own.user_id, "left").drop("user_id")
    return joined.fillna(0, ["profiles", "used_today", "used_7d", "used_30d"])


def unlisted_companies(postings: DataFrame, registry: DataFrame, least: int = 1, top: int = 80) -> DataFrame:
    """Names that postings have and the registry lacks, by how often they occur."""
    known = registry.select(F.lower("name").alias("_name")).distinct()
    named = postings.where("company is not null").groupBy("company").agg(F.count("*").alias("jobs")).where(F.col("jobs") >= least)
    return named.join(known, F.lower("company") == F.col("_name"), "left_anti").orderBy(F.col("jobs").desc(), "company").limit(top)


def discovery_rank(boards: DataFrame) -> list[Column]:
    return [F.col("junior").desc(), F.col("relevant").desc(), F.col("total").asc()]


def rate_limited(events: DataFrame, client: str, ts: str, most: int, seconds: int = 60) -> DataFrame:
    """Clients with more than ``most`` events in a fixed window."""
    counted = events.groupBy(client, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(client, F.col("w.start").alias("window_start"), "n")


def user_export(tables: dict[str, DataFrame], user_id: str) -> DataFrame:
    """One JSON text of all rows that a user owns, by table; bounded by what one user owns."""
    parts = [t.where(F.col("user_id") == user_id).agg(F.to_json(F.collect_list(F.struct("*"))).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
