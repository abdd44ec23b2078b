"""The stream of rate limits against its batch version."""

from datetime import datetime, timedelta

from postmill.operators import analytics
from postmill.streaming import ingest
from pyspark.sql import functions as F


def test_rate_limits_of_a_stream(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(k % 3, begin + timedelta(seconds=20 * k)) for k in range(60)] + [(9, begin + timedelta(seconds=k)) for k in range(5)]
    events = spark.createDataFrame(rows, "client int, ts timestamp")
    for part in range(3):
        events.where(F.pmod(F.unix_seconds("ts"), F.lit(3)) == part).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    found = ingest.rate_limits(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "client", "ts", 1)
    found.writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    ended = begin + timedelta(seconds=20 * 59) - timedelta(minutes=2)  # windows that the watermark has passed
    batch = {(r.client, r.window_start) for r in analytics.rate_limited(events, "client", "ts", 1, 60).collect()}
    wanted = {(client, start) for client, start in batch if start + timedelta(seconds=60) <= ended}
    assert {(r.client, r.window_start) for r in spark.table("limits").collect()} == wanted and wanted
