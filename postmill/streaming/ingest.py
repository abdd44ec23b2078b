"""Streams: landed files merged into a table by micro-batches, and rate limits over event time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import merge_replace
from ..sources import vendors
from ..sources.bucketed import BucketedTable


def landed(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """Payload files as they arrive: JSON lines of ``board, name, employer_type, country, payload``."""
    return spark.readStream.schema("board string, name string, employer_type string, country string, payload string").option("maxFilesPerTrigger", most_files).json(path)


def ingest(payloads: DataFrame, vendor: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, as_of: datetime) -> StreamingQuery:
    """Merges each batch's postings by ``job_id``. ``write`` gets the batch's number, so that a repeated batch replaces its own version: the merge is idempotent."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh = vendors.canonical(vendors.parse(vendor, batch), as_of)
        write(merge_replace(read(), fresh, ["job_id"], F.struct("posted_date", "url")), number)

    return payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(payloads: DataFrame, vendor: str, table: BucketedTable, checkpoint: str, as_of: datetime) -> StreamingQuery:
    """Merges each batch's postings into a stored table by ``job_id``: a batch writes only the folders that it changes, and a repeated one none."""

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(vendors.canonical(vendors.parse(vendor, batch), as_of), F.struct("posted_date", "url"))

    return payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limits(events: DataFrame, client: str, ts: str, most: int, late: str = "2 minutes", seconds: int = 60) -> DataFrame:
    """Clients over their limit in tumbling windows; windows end when the watermark passes them."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), client).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(client, F.col("w.start").alias("window_start"), "n")
