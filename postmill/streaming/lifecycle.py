"""Boards followed as a stream: when a posting was first and last listed, and when a complete crawl no longer had it.

A posting closes at the first complete crawl of its board after it was last seen, and a later sighting opens it again. So its state follows from the set of sightings and
complete crawls alone: any split of the input into batches, in any order, ends in the same table as ``state.snapshot`` crawl by crawl.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.bucketed import BucketedTable

#: What a crawl delivers: a row for each posting that a board lists, and one that is ``complete`` if the whole board was read.
CRAWL = "ats string, board_slug string, job_id string, crawled_at timestamp, complete boolean"
#: The table of ``state.snapshot``.
PRESENCE = "ats string, board_slug string, job_id string, first_seen timestamp, last_seen timestamp, closed_at timestamp"
_CHANGED = "ats string, board_slug string, job_id string, first bigint, last bigint, closed bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Board(StatefulProcessor):
    """One share of a board's postings. Times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getListState("jobs", "job_id string, first bigint, last bigint, closed bigint")
        self.crawls = handle.getListState("crawls", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        crawls, jobs = {r[0] for r in self.crawls.get()}, {r[0]: r[1:] for r in self.jobs.get()}
        new = {int(at) for at in came.loc[came["complete"], "at"]} - crawls
        if new:
            self.crawls.put([(at,) for at in sorted(crawls | new)])
        order, changed = sorted(crawls | new), set()
        seen = came[~came["complete"]].groupby("job_id")["at"].agg(["min", "max"])
        for job, first, last in seen.itertuples(name=None):
            old = jobs.get(job)
            jobs[job] = (min(int(first), old[0]), max(int(last), old[1]), old[2]) if old else (int(first), int(last), None)
            if jobs[job] != old:
                changed.add(job)
        for job in jobs if new else list(changed):
            first, last, closed = jobs[job]
            after = bisect_right(order, last)
            now = order[after] if after < len(order) else None
            if now != closed:
                jobs[job] = (first, last, now)
                changed.add(job)
        if changed:
            self.jobs.put([(job, *times) for job, times in jobs.items()])
            told = sorted(changed)
            columns = {name: pd.array([jobs[j][k] for j in told], dtype="Int64") for k, name in enumerate(("first", "last", "closed"))}
            yield pd.DataFrame({"ats": key[0], "board_slug": key[1], "job_id": told, **columns})

    def close(self) -> None:
        pass


def changes(crawls: DataFrame, shares: int = 16) -> DataFrame:
    """A stream of ``CRAWL`` as a stream of changed rows of ``PRESENCE``, in update mode.

    A board's postings are dealt into ``shares`` by hash, so that a large board isn't one task's state; complete crawls go to each. A batch rewrites the state of the shares in which something
    changed. Rows without ``ats``, ``board_slug`` or ``crawled_at``, and sightings without ``job_id``, are passed over. The state keeps closed postings and the times of all complete crawls.
    """
    whole = F.coalesce("complete", F.lit(False))
    rows = crawls.where("ats IS NOT NULL AND board_slug IS NOT NULL AND crawled_at IS NOT NULL").where(whole | F.col("job_id").isNotNull())
    share = F.when(whole, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.pmod(F.xxhash64("job_id"), F.lit(shares)).cast("int")))
    rows = rows.select("ats", "board_slug", F.explode(share).alias("share"), F.when(~whole, F.col("job_id")).alias("job_id"), F.unix_micros("crawled_at").alias("at"), whole.alias("complete"))
    told = rows.groupBy("ats", "board_slug", "share").transformWithStateInPandas(_Board(), _CHANGED, "Update", "None")
    return told.select("ats", "board_slug", "job_id", *[F.timestamp_micros(a).alias(b) for a, b in (("first", "first_seen"), ("last", "last_seen"), ("closed", "closed_at"))])


def follow(crawls: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, shares: int = 16) -> StreamingQuery:
    """Starts the stream: ``write`` gets each batch's changed rows and its number."""
    conf = crawls.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one that has lists; a stream copies the settings it starts with
    try:
        return changes(crawls, shares).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before)


def follow_into(crawls: DataFrame, table: BucketedTable, checkpoint: str, shares: int = 16) -> StreamingQuery:
    """Merges changes into a stored table of ``PRESENCE``; a batch that is run again writes nothing new."""

    def merge(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # a merge reads its delta several times
        try:
            table.merge(kept)
        finally:
            kept.unpersist()

    return follow(crawls, merge, checkpoint, shares)
