"""Tables that change: merges of a base and a delta, snapshots, retention, quotas. Every function returns the new table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def merge_replace(base: DataFrame, delta: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of the delta replace those of equal keys; of several in the delta, the last by ``order``."""
    if order is not None:
        last = Window.partitionBy(*keys).orderBy(order.desc())
        delta = delta.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn")
    return base.join(delta.select(*keys), keys, "left_anti").select(*delta.columns).unionByName(delta)


def merge_sum(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    return base.select(*keys, value).unionByName(delta.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_coalesce(base: DataFrame, delta: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """As ``merge_replace``, but a null of the delta in a ``keep`` column leaves the base's value. Both sides have unique keys."""
    old = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
    new = delta.join(old, keys, "left").select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in keep else F.col(c) for c in delta.columns])
    return base.join(delta.select(*keys), keys, "left_anti").select(*delta.columns).unionByName(new)


def insert_missing(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def update_where(base: DataFrame, where: Column, **values: Column) -> DataFrame:
    return base.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def delete_where(base: DataFrame, where: Column) -> DataFrame:
    return base.where(~F.coalesce(where, F.lit(False)))


def delete_owned(tables: dict[str, DataFrame], owners: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of ``owners``."""
    return {name: t.join(owners.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def purge(postings: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Without rows posted before the cutoff or, where that is unknown, ingested before it."""
    return delete_where(postings, F.coalesce("posted_date", "ingested_at") < dates.moment(cutoff))


def snapshot(presence: DataFrame, seen: DataFrame, complete: DataFrame, as_of: datetime | Column) -> DataFrame:
    """The presence table after a crawl: seen rows open or reopen and keep ``first_seen``; open rows missing from a complete board close.

    presence: ats, board_slug, job_id, first_seen, last_seen, closed_at. seen: ats, board_slug, job_id. complete: ats, board_slug.
    """
    board, keys, now = ["ats", "board_slug"], ["ats", "board_slug", "job_id"], dates.moment(as_of)
    now_seen, whole = seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), complete.select(*board).distinct().withColumn("_whole", F.lit(True))
    joined = presence.join(now_seen, keys, "full").join(whole, board, "left")
    here, missing = F.col("_seen").isNotNull(), F.col("_whole").isNotNull()
    return joined.select(
        *keys, F.coalesce("first_seen", now).alias("first_seen"), F.when(here, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here, None).when(missing, F.coalesce("closed_at", now)).otherwise(F.col("closed_at")).alias("closed_at"),
    )


def listed_open(postings: DataFrame, presence: DataFrame) -> DataFrame:
    """Postings that some board lists."""
    return postings.join(presence.where("closed_at is null").select("job_id").distinct(), "job_id", "left_semi")


def apply_lifecycle(postings: DataFrame, presence: DataFrame, as_of: datetime | Column) -> DataFrame:
    """A posting that some board lists is active; one that was listed and is no longer is closed; others stay as they are."""
    listed = presence.groupBy("job_id").agg(F.count_if(F.col("closed_at").isNull()).alias("_open"))
    joined, now = postings.join(listed, "job_id", "left"), dates.moment(as_of)
    closed = F.when(F.col("_open") > 0, None).when(F.col("_open") == 0, F.coalesce("closed_at", now)).otherwise(F.col("closed_at"))
    active = F.when(F.col("_open") > 0, True).when(F.col("_open") == 0, False).otherwise(F.col("is_active"))
    return joined.withColumns({"is_active": active, "closed_at": closed}).select(*postings.columns)


def restamp(postings: DataFrame, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """The table with a recomputed column, and how many rows it changed."""
    changed = postings.agg(F.count_if(~F.col(column).eqNullSafe(value)).alias("changed"), F.count("*").alias("total"))
    return postings.withColumn(column, value), changed


def quota_left(usage: DataFrame, limits: DataFrame, period: str) -> DataFrame:
    """``user_id, metric, used, allowed, breached`` of a period; a limit of null or below 0 allows everything."""
    used = usage.where(F.col("period") == period).groupBy("user_id", "metric").agg(F.sum("count").alias("used"))
    joined = limits.join(used, ["user_id", "metric"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return joined.select("user_id", "metric", "used", "allowed", F.coalesce((F.col("allowed") >= 0) & (F.col("used") >= F.col("allowed")), F.lit(False)).alias("breached"))


def reap_runs(runs: DataFrame, as_of: datetime | Column) -> DataFrame:
    return update_where(runs, F.col("status") == "running", status=F.lit("interrupted"), finished_at=dates.moment(as_of))


def registry(*layers: DataFrame, keys: tuple[str, ...] = ("ats", "slug")) -> DataFrame:
    """Layers of the company registry; of rows with equal keys the last layer's wins."""
    out = None
    for k, layer in enumerate(layers):
        own = layer.withColumn("_layer", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.col("_layer").desc(), *[c for c in layers[0].columns if c not in keys])
    return out.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn", "_layer")


def keep_first(*layers: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered union: of rows with equal keys the first layer's stays."""
    return registry(*reversed(layers), keys=tuple(keys))


def active_document(owners: DataFrame, documents: DataFrame, active: str, columns: list[str]) -> DataFrame:
    """Owners with the fields of their active document, their own where it has none."""
    own = documents.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_doc_{c}") for c in columns])
    joined = owners.join(own, F.col(active) == F.col("_id"), "left")
    return joined.select(*[F.coalesce(f"_doc_{c}", c).alias(c) if c in columns else F.col(c) for c in owners.columns])


def cache_probe(asked: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Asked rows with the cached ``data``; null where there is none or its fingerprint is another."""
    found = cache.select(*keys, F.col("fingerprint"), "data")
    return asked.join(found, [*keys, "fingerprint"], "left")
