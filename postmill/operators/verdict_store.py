"""Verdicts that are kept: after an update only pairs of which the posting or the profile changed are scored.

A refresh compares fingerprints with those of the one before. Each posting and profile keeps the number of the refresh that last changed it, each stored verdict that of the refresh that made it,
and a verdict holds as long as its number is the larger of its two sides'. So outdated rows need no deletion, and pairs that no longer fit vanish with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SINCE = "id string, print string, since int"


@dataclass
class VerdictStore:
    """Verdicts below ``path``. ``score`` takes postings and profiles and gives rows with ``job_id`` and ``profile_id``, for each pair by itself (as ``profiles.feeds`` does).

    ``rules`` names what else a verdict hangs on (versions, thresholds): if it changes, all is scored anew. ``unread`` are columns of postings that no verdict hangs on.
    One writer at a time. A refresh that fails changes nothing and is simply run again; the numbers of the one before stay readable meanwhile.
    """

    spark: SparkSession
    path: str
    score: Callable[[DataFrame, DataFrame], DataFrame]
    rules: str = ""
    unread: tuple[str, ...] = field(default=("ingested_at", "last_seen_at"))

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _head(self) -> dict:
        """The number of the last whole refresh, the rules it had, and the folders of verdicts that may hold."""
        fs, heads = self._file("heads")
        done = [int(s.getPath().getName()) for s in fs.listStatus(heads) if fs.exists(self._file(f"heads/{s.getPath().getName()}/_SUCCESS")[1])] if fs.exists(heads) else []
        if not done:
            return {"number": 0, "rules": self.rules, "parts": []}
        return self.spark.read.schema("number int, rules string, parts array<int>").json(f"{self.path}/heads/{max(done)}").first().asDict()

    def _sides(self, number: int, kind: str) -> DataFrame:
        return self.spark.read.schema(_SINCE).parquet(f"{self.path}/{kind}/{number}") if number else self.spark.createDataFrame([], _SINCE)

    def _compare(self, rows: DataFrame, key: str, unread: tuple[str, ...], kind: str, head: dict) -> DataFrame:
        """Stores which refresh last changed each row; the fingerprint of an id is that of all its rows."""
        number = head["number"] + 1
        told = F.md5(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in unread))))
        prints = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.md5(F.concat_ws("", F.array_sort(F.collect_list(told)))).alias("print"))
        old = self._sides(head["number"], kind).select("id", F.col("print").alias("_old"), "since")
        kept: Column = (F.col("print") == F.col("_old")) & F.lit(head["rules"] == self.rules)
        prints.join(old, "id", "left").select("id", "print", F.when(kept, F.col("since")).otherwise(number).alias("since")).write.mode("overwrite").parquet(f"{self.path}/{kind}/{number}")
        return self._sides(number, kind)

    def refresh(self, postings: DataFrame, profiles: DataFrame) -> dict[str, int]:
        """Brings the verdicts up to these tables. Returns how many ``postings`` and ``profiles`` changed, and how many rows were ``scored``.

        Changed postings meet all profiles, the others only changed profiles. Rows without an id aren't judged; rows of one id are judged each, as ``score`` does.
        """
        head = self._head()
        number = head["number"] + 1
        sides = {"postings": self._compare(postings, "job_id", self.unread, "postings", head), "profiles": self._compare(profiles, "id", (), "profiles", head)}
        changed = {kind: side.where(F.col("since") == number).select(F.col("id").alias("_id")) for kind, side in sides.items()}
        many = {kind: ids.count() for kind, ids in changed.items()}
        own, who, parts = F.col("job_id").cast("string") == F.col("_id"), F.col("id").cast("string") == F.col("_id"), []
        if many["postings"]:
            parts.append(self.score(postings.join(changed["postings"], own, "left_semi"), profiles.where("id IS NOT NULL")))
        if many["profiles"]:
            rest = postings.where("job_id IS NOT NULL").join(changed["postings"], own, "left_anti") if many["postings"] else postings.where("job_id IS NOT NULL")
            if many["postings"] < sides["postings"].count():
                parts.append(self.score(rest, profiles.join(changed["profiles"], who, "left_semi")))
        scored, folders = 0, [] if head["rules"] != self.rules else list(head["parts"])
        for k, part in enumerate(parts):
            part.withColumn("_made", F.lit(number)).write.mode("overwrite" if k == 0 else "append").parquet(f"{self.path}/verdicts/{number}")
        if parts:
            scored = self.spark.read.parquet(f"{self.path}/verdicts/{number}").count()
            folders.append(number)
        self.spark.createDataFrame([(number, self.rules, folders)], "number int, rules string, parts array<int>").coalesce(1).write.mode("overwrite").json(f"{self.path}/heads/{number}")
        for kind in ("heads", "postings", "profiles"):  # readers may still be at the one before
            fs, old = self._file(f"{kind}/{number - 2}")
            fs.delete(old, True)
        return {**many, "scored": scored}

    def read(self) -> DataFrame:
        """The verdicts of the last refresh's tables, equal to scoring all pairs."""
        head = self._head()
        if not head["parts"]:
            raise ValueError("no verdict was stored yet")
        rows = self.spark.read.parquet(*[f"{self.path}/verdicts/{n}" for n in head["parts"]])
        sides = {kind: self._sides(head["number"], kind).select(F.col("id").alias(f"_{kind}"), F.col("since").alias(f"_since_{kind}")) for kind in ("postings", "profiles")}
        both = rows.join(sides["postings"], F.col("job_id").cast("string") == F.col("_postings")).join(sides["profiles"], F.col("profile_id").cast("string") == F.col("_profiles"))
        return both.where(F.col("_made") == F.greatest("_since_postings", "_since_profiles")).select(*[c for c in rows.columns if c != "_made"])

    def compact(self) -> None:
        """Writes the verdicts that hold into one folder, without scoring; the older folders can be deleted when no reader needs them."""
        head = self._head()
        number = head["number"] + 1
        held = self.read()
        for kind in ("postings", "profiles"):
            self._sides(head["number"], kind).write.mode("overwrite").parquet(f"{self.path}/{kind}/{number}")
        since = {kind: self._sides(head["number"], kind).select(F.col("id").alias(f"_{kind}"), F.col("since").alias(f"_since_{kind}")) for kind in ("postings", "profiles")}
        both = held.join(since["postings"], F.col("job_id").cast("string") == F.col("_postings")).join(since["profiles"], F.col("profile_id").cast("string") == F.col("_profiles"))
        both.select(*held.columns, F.greatest("_since_postings", "_since_profiles").alias("_made")).write.mode("overwrite").parquet(f"{self.path}/verdicts/{number}")
        self.spark.createDataFrame([(number, head["rules"], [number])], "number int, rules string, parts array<int>").coalesce(1).write.mode("overwrite").json(f"{self.path}/heads/{number}")
